"""Benchmark decontamination with a distributed positional inverted index.

The index. A segment is a few megabytes of whole documents. Its words are numbered in
order of position, with a gap between documents that no phrase can bridge. Each distinct
word of a segment is one row ``segment, term, n, positions``, written as a table: the
postings of every token of the corpus. Beside them a row per segment lists its documents
and where each begins.

The search. Each item gives windows of consecutive words. For a window, terms are ordered
by their count in the whole corpus, rarest first. A window is looked for only in segments
that hold its rarest term: there its posting list, shifted by the term's offset, gives
the candidate starts, and the next rarest lists, shifted by theirs, are intersected one
after the other until no candidate is left or the window is used up. What is left is an
exact phrase. With ``slop``, candidates also stay if terms lie up to that many words from
their places: proximity matches.

The rest is relational: occurrences are merged into covered words of a document, windows
are led back to items. Copies of an item are one class; documents with the same found
windows share one list of items, so a passage that a third of all documents and a third
of all items share is expanded once and not for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm import blocks
from caudal.llm.tables import kept, whole_text

WINDOW = 10
SLOP = 1
_SEARCHED = 200_000  # windows looked for in a segment at once, on average: bounds a task's memory

# Words: lower-cased letters, digits, and every character beyond ASCII. In UTF-8 those
# are the bytes from 0x80, so bytes can be cut without decoding them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split(b" ")


def item_words() -> Column:
    """The same words of column ``text`` as an array, by built-in functions."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    folded = F.translate(whole_text(), capitals, capitals.lower())
    return F.regexp_extract_all(folded, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))


def to_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as groups of 7 bits, lowest first, the high bit set on all but a number's last; and where each ends."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >> bits > 0
    stops = np.cumsum(size)
    out = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        longer = np.flatnonzero(size > k)
        more = (size[longer] > k + 1).astype(np.uint8) << 7
        out[stops[longer] - size[longer] + k] = (values[longer] >> (7 * k) & 0x7F).astype(np.uint8) | more
    return out, stops


def from_varints(data: np.ndarray) -> np.ndarray:
    stops = np.flatnonzero(data < 0x80) + 1
    begins = np.concatenate(([0], stops[:-1])).astype(np.int64)[: len(stops)]
    size = stops - begins
    out = np.zeros(len(stops), np.int64)
    for k in range(int(size.max(initial=0))):
        longer = np.flatnonzero(size > k)
        out[longer] |= (data[begins[longer] + k].astype(np.int64) & 0x7F) << (7 * k)
    return out


def index(docs: DataFrame, gap: int, block_chars: int = blocks.BLOCK_CHARS) -> DataFrame:
    """The index of ``docs`` (``doc_id, text``), a written table ``segment, term, n, positions``.

    ``positions`` are a term's ascending places in the segment, as steps of 7 bits a byte
    (``to_varints``). The row whose term is null holds the segment's documents
    (Arrow: ``doc_id, begin, n_words``). ``gap`` is the distance between documents.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list, list]]:
        ids, words, sizes, chars, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = [w for w in words_of(text) if w]
                ids.append(doc)
                sizes.append(len(found))
                words.append(pa.array(found, pa.binary()))
                chars += len(text)
                if chars >= block_chars:
                    yield pa.array(ids, kind), words, sizes
                    ids, words, sizes, chars = [], [], [], 0
        if ids:
            yield pa.array(ids, kind), words, sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (ids, words, sizes) in enumerate(segments(batches)):
            segment = (part << 32) + number
            size = np.array(sizes, np.int64)
            begin = np.cumsum(size + gap) - size - gap
            coded = pa.concat_arrays(words).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            place = np.arange(len(codes)) + np.repeat(begin - (np.cumsum(size) - size), size)
            order = np.argsort(codes, kind="stable")
            counts = np.bincount(codes, minlength=len(coded.dictionary))
            ends = np.cumsum(counts)
            places = place[order]
            steps = np.diff(places, prepend=0)
            steps[ends - counts] = places[ends - counts]
            table = pa.table({"doc_id": ids, "begin": pa.array(begin), "n_words": pa.array(size)})
            yield _rows([segment], pa.array([None], pa.string()), [len(ids)], pa.array([blocks.to_bytes(table)], pa.binary()))
            data, stops = to_varints(steps)
            cuts = np.concatenate(([0], stops[ends - 1])).astype("<i4")
            positions = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
            yield _rows(np.full(len(counts), segment), coded.dictionary.cast(pa.string()), counts, positions)

    texts = docs.select("doc_id", whole_text().alias("text"))
    return kept(texts.mapInArrow(run, "segment long, term string, n long, positions binary"), "phrase-index")


def _rows(segment, term: pa.Array, n, positions: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(segment, pa.int64()), term, pa.array(n, pa.int64()), positions]
    return pa.RecordBatch.from_arrays(columns, ["segment", "term", "n", "positions"])


def windows(items: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct windows (``window, terms``), their item classes (``window, class``), and
    the items of a class (``class, item_id``), three written tables.

    A class is the items with the same words. An item with fewer words than ``length``
    is one window, without words it has none.
    """
    words = kept(items.select("item_id", item_words().alias("words")).filter(F.size("words") > 0), "items")
    classes = words.withColumn("class", F.sha2(F.concat_ws(" ", "words"), 256))
    distinct = classes.groupBy("class").agg(F.first("words").alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (length - 1), F.lit(1)))
    cut = F.transform(starts, lambda at: F.slice("words", at, length))
    every = distinct.select("class", F.explode(cut).alias("terms"))
    every = every.withColumn("window", F.sha2(F.concat_ws(" ", "terms"), 256))
    found = kept(every.groupBy("window", "class").agg(F.first("terms").alias("terms")), "item-windows")
    return (
        kept(found.groupBy("window").agg(F.first("terms").alias("terms")), "windows"),
        kept(found.select("window", "class"), "window-classes"),
        kept(classes.select("class", "item_id"), "item-classes"),
    )


def _rarest_first(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """``window, terms, offsets`` with the terms by rising corpus count; windows with a missing term leave."""
    places = wanted.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    ranked = places.join(terms, "term").groupBy("window", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("order")  # a window's words at most
    )
    return ranked.filter(F.size("order") == F.col("size")).select(
        "window", F.col("order.term").alias("terms"), F.col("order.offset").alias("offsets")
    )


def _nearest(sorted_places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Distance from each of ``wanted`` to the nearest of ``sorted_places``."""
    at = np.searchsorted(sorted_places, wanted)
    after = sorted_places[np.minimum(at, len(sorted_places) - 1)]
    before = sorted_places[np.maximum(at - 1, 0)]
    return np.minimum(np.abs(after - wanted), np.abs(before - wanted))


def starts_of(lists: dict[str, np.ndarray], terms: list[str], offsets: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a window, and whether each is exact. ``terms`` come rarest first.

    A start matches if every term has a place within ``slop`` of start plus offset. Of
    proximity matches at neighbouring starts the first counts, and none within ``slop``
    of an exact one.
    """
    start = lists.get(terms[0], np.zeros(0, np.int64)) - offsets[0]
    if slop:
        start = np.unique(start + np.arange(-slop, slop + 1)[:, None])
    exact = np.ones(len(start), bool)
    for term, offset in zip(terms, offsets):
        places = lists.get(term)
        if places is None or not len(start):
            return start[:0], exact[:0]
        away = _nearest(places, start + offset)
        near = away <= slop
        start, exact = start[near], exact[near] & (away[near] == 0)
    if not exact.all():
        stays = np.diff(start, prepend=start[0] - 2) > 1
        if exact.any():
            stays &= _nearest(start[exact], start) > slop
        stays |= exact
        start, exact = start[stays], exact[stays]
    return start, exact


def matches(docs: DataFrame, wanted: DataFrame, length: int = WINDOW, slop: int = SLOP, block_chars: int = blocks.BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """All places of the windows ``wanted`` (``window, terms``) in ``docs``, and the documents.

    Places: ``segment, doc, window, size, start, exact``: ``doc`` is the document's number
    in its segment, ``start`` the word the window begins with, ``exact`` whether the words
    follow each other as in the window or some lie up to ``slop`` places off theirs (in
    such a match the window may begin before the document's first word or end after its last).
    Documents: ``segment, doc, doc_id, n_words``. Ids may be null or repeat, as documents
    are told apart by segment and number.
    """
    spark = docs.sparkSession
    postings = index(docs, length + 2 * slop, block_chars)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def list_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, body in zip(batch.column(0), batch.column(1)):
                table = blocks.from_bytes(body.as_py())
                n = len(table)
                columns = [pa.array([segment.as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32))]
                table = table.combine_chunks()
                columns += [pa.concat_arrays(table.column(c).chunks) if n else pa.array([]) for c in ("doc_id", "n_words")]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "doc", "doc_id", "n_words"])

    heads = postings.filter("term is null").select("segment", "positions")
    documents = heads.mapInArrow(list_documents, f"segment long, doc int, doc_id {kind}, n_words long")

    known = wanted.select(F.explode("terms").alias("term")).distinct()
    asked = kept(postings.join(known, "term", "left_semi"), "asked-postings")
    terms = kept(asked.groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
    ordered = kept(_rarest_first(wanted, terms), "ordered-windows")
    # A segment's windows are searched in slices of a bounded size on average.
    slices = ordered.count() // _SEARCHED + 1
    searched = (
        ordered.withColumn("term", F.col("terms")[0])
        .join(asked.select("segment", "term"), "term")
        .select("segment", F.pmod(F.xxhash64("window"), F.lit(slices)).alias("slice"), "window", "terms", "offsets")
    )
    lists = asked.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    lists = lists.select("segment", "slice", F.struct("term", "n", "positions").alias("posting"), F.lit(None).alias("wanted"))
    heads = heads.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    head = F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), "positions").alias("posting")
    heads = heads.select("segment", "slice", head, F.lit(None).alias("wanted"))
    searched = searched.select("segment", "slice", F.lit(None).alias("posting"), F.struct("window", "terms", "offsets").alias("wanted"))

    def search(part: pa.Table) -> pa.Table:
        postings, asked = part.column("posting").combine_chunks(), part.column("wanted").combine_chunks()
        segment = part.column("segment")[0].as_py()
        term, n, positions = postings.filter(postings.is_valid()).flatten()
        begins = blocks.from_bytes(positions.filter(term.is_null())[0].as_py()).column("begin").to_numpy()
        found, known = {}, term.is_valid()
        counts = n.filter(known).to_numpy()
        data = np.frombuffer(b"".join(positions.filter(known).to_pylist()), np.uint8)
        places, stops = np.cumsum(from_varints(data)), np.cumsum(counts)
        before = np.concatenate(([0], places))[stops - counts]  # every list begins anew
        for name, stop, count, base in zip(term.filter(known).to_pylist(), stops, counts, before):
            found[name] = places[stop - count : stop] - base
        out = []
        for row in asked.filter(asked.is_valid()).to_pylist():
            start, exact = starts_of(found, row["terms"], row["offsets"], slop)
            if len(start):
                # The rarest term lies within slop of its place, and the next document beyond twice that.
                doc = np.searchsorted(begins, start + row["offsets"][0] + slop, side="right") - 1
                out.append((row["window"], len(row["terms"]), doc, start - begins[doc], exact))
        counts = np.array([len(o[2]) for o in out], np.int64)
        each = np.repeat(np.arange(len(out)), counts)

        def together(i: int, dtype) -> np.ndarray:
            return np.concatenate([np.zeros(0, dtype), *(o[i] for o in out)]).astype(dtype)

        return pa.table(
            {
                "segment": pa.array(np.full(len(each), segment, np.int64)),
                "doc": pa.array(together(2, np.int32)),
                "window": pa.array([o[0] for o in out], pa.string()).take(pa.array(each)),
                "size": pa.array(np.array([o[1] for o in out], np.int32)[each]),
                "start": pa.array(together(3, np.int64)),
                "exact": pa.array(together(4, bool)),
            }
        )

    rows = lists.unionByName(heads).unionByName(searched)
    places = rows.groupBy("segment", "slice").applyInArrow(
        search, "segment long, doc int, window string, size int, start long, exact boolean"
    )
    return kept(places, "phrase-places"), documents


def covered(places: DataFrame) -> DataFrame:
    """``segment, doc, n_hit``: words of a document inside any exact place."""
    key = ["segment", "doc"]
    spans = places.filter("exact").groupBy(*key, "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    earlier = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(earlier), F.lit(0))
    fresh = F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0))
    return spans.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW, slop: int = SLOP, block_chars: int = blocks.BLOCK_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, item_ids, n_near``.

    ``n_hit`` words lie inside an occurrence of some window of ``items`` (``item_id,
    text``), ``item_ids`` lists the items with such windows, sorted as strings, and
    ``n_near`` counts distinct windows that the document has only as proximity matches.
    Null and empty texts have no words and no windows. Null item ids are left out of the
    lists, ids that repeat count once. Rows that repeat a document's id, and null ids,
    keep their own rows; other columns are ignored. Empty tables: no rows, or no hits.
    """
    wanted, window_classes, item_classes = windows(items, length)
    places, documents = matches(docs, wanted, length, slop, block_chars)
    key = ["segment", "doc"]
    found = places.groupBy(*key, "window").agg(F.bool_or("exact").alias("exact"))
    near = F.count_if(~F.col("exact")).alias("n_near")
    # A document's distinct windows: bounded by its own length.
    hits = F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("window")))).alias("hits")
    marked = kept(
        found.groupBy(*key).agg(near, hits).withColumn("set", F.when(F.size("hits") > 0, F.sha2(F.concat_ws(",", "hits"), 256))),
        "found-windows",
    )
    sets = marked.filter("set is not null").groupBy("set").agg(F.first("hits").alias("hits"))
    ids = (
        sets.select("set", F.explode("hits").alias("window"))
        .join(window_classes, "window")
        .select("set", "class")
        .distinct()
        .join(item_classes, "class")
        .select("set", F.col("item_id").cast("string").alias("item_id"))
    )
    # The ids of one list; the list itself is the result.
    lists = kept(ids.groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")), "item-lists")
    return (
        documents.join(covered(places), key, "left")
        .join(marked.select(*key, "set", "n_near"), key, "left")
        .join(lists, "set", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        )
    )
