"""Fixed values of the banking domain: accepted values, shares, ranges, seeds."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
PAISES = ("México", "Guatemala", "El Salvador", "Honduras", "Costa Rica", "Estados Unidos")

CIUDADES = {
    "México": ("Ciudad de México", "Guadalajara", "Monterrey"),
    "Guatemala": ("Ciudad de Guatemala", "Quetzaltenango", "Antigua", "Cobán", "Escuintla"),
    "El Salvador": ("San Salvador", "Santa Ana"),
    "Honduras": ("Tegucigalpa", "San Pedro Sula"),
    "Costa Rica": ("San José", "Cartago"),
    "Estados Unidos": ("Los Angeles", "Houston", "Miami"),
}

# With the shares by which stand-in values are drawn.
SEGMENTOS = {"PERSONAL": 0.75, "PREMIUM": 0.15, "BUSINESS": 0.10}
TIPOS_CUENTA = ("AHORROS", "CORRIENTE", "CREDITO")
MONEDAS = {"GTQ": 0.75, "USD": 0.2, "EUR": 0.05}
ESTADOS = ("ACTIVA", "CERRADA", "CONGELADA")
TIPOS_TX = ("DEPOSITO", "RETIRO", "TRANSFERENCIA", "PAGO_TARJETA", "COMPRA_ONLINE")
CANALES = ("APP", "WEB", "CAJERO", "SUCURSAL", "POS")

COMERCIOS = {
    "SUPERMERCADO": ("La Torre", "Walmart", "Paiz", "Despensa Familiar"),
    "RESTAURANTE": ("Pollo Campero", "McDonalds", "Sarita", "Domino's"),
    "GASOLINERA": ("Puma", "Texaco", "Shell"),
    "FARMACIA": ("Farmacia Galeno", "Cruz Verde", "Batres"),
    "TECNOLOGIA": ("Amazon", "Apple Store", "MercadoLibre"),
    "TRANSPORTE": ("Uber", "InDriver", "Aerolínea Avianca"),
    "ENTRETENIMIENTO": ("Netflix", "Spotify", "Cinemark"),
}

# Amount range per transaction type, both ends included.
RANGOS_MONTO = {
    "DEPOSITO": (50, 10_000),
    "RETIRO": (20, 2_000),
    "TRANSFERENCIA": (10, 50_000),
    "PAGO_TARJETA": (5, 1_500),
    "COMPRA_ONLINE": (5, 1_500),
}

# Types that name a merchant; all others leave merchant and category empty.
TIPOS_CON_COMERCIO = ("PAGO_TARJETA", "COMPRA_ONLINE")

# The only type that brings money in.
TIPOS_ENTRADA = ("DEPOSITO",)

# Key formats: prefix and least number of digits.
FORMATO_CLIENTE = ("CLI", 6)
FORMATO_CUENTA = ("ACC", 8)
FORMATO_TRANSACCION = ("TX", 10)

PROPORCION_MONTO_NULO = 0.02
PROPORCION_DUPLICADOS = 0.01
PROPORCION_PAIS_PROPIO = 0.95
