"""The word lists and tables that the catalogue's text rules rest on."""

from __future__ import annotations

# Spellings of units, each with the form that search and matching use.
UNITS = {
    "metros": "m", "metro": "m", "mts": "m", "mt": "m",
    "pulgadas": "pulg", "pulgada": "pulg", "plg": "pulg",
    "centimetros": "cm", "centimetro": "cm", "milimetros": "mm", "milimetro": "mm",
    "kilogramos": "kg", "kilogramo": "kg", "kilos": "kg", "kilo": "kg",
    "galones": "galon", "libras": "lb", "libra": "lb",
    "amperios": "a", "amperaje": "a", "amp": "a", "amps": "a",
    "watts": "w", "vatios": "w", "voltios": "v", "volts": "v", "volt": "v",
}

STOP_WORDS = ("de", "para", "con", "el", "la", "los", "las", "un", "una", "y", "o", "del", "en")

# Words that stand for each other in searches: by gender and number, then by trade.
SAME_WORD = (
    ("blanco", "blanca", "blancos", "blancas"),
    ("rojo", "roja", "rojos", "rojas"),
    ("negro", "negra", "negros", "negras"),
    ("gris", "grises"),
    ("pequeno", "pequena", "pequenos", "pequenas"),
    ("grande", "grandes"),
    ("bloque", "bloques", "block", "blocks"),
    ("perlin", "perlines", "perfil", "perfiles"),
)

ACCESSORY_WORDS = ("para", "accesorio", "accesorios", "repuesto", "repuestos", "soporte", "soportes", "filtro", "filtros", "adaptador", "adaptadores")
ACTING_WORDS = ("quita", "limpia", "limpiador", "limpiadores", "removedor", "removedores", "destapador", "destapadores", "desmanchador", "desmanchadores", "quitamanchas")
SKIPPED_PREPOSITIONS = ("de", "para")

GENERIC_TOKENS = ("w", "kw", "v", "hp", "amp", "a", "hz", "pulg", "mm", "cm", "m", "kg", "g", "lb", "lbs", "oz", "ml", "lt", "l", "gal", "x")

PART_WORDS = ("repuesto", "repuestos", "accesorio", "accesorios", "kit", "refaccion", "refacciones", "reparacion", "empaque", "empaques", "junta", "juntas", "cubierta", "cubiertas", "cubre")

COLOURS = (
    "rojo", "verde", "azul", "amarillo", "blanco", "negro", "gris", "cafe", "naranja", "morado", "violeta", "rosado", "rosa", "dorado", "plateado",
    "beige", "celeste", "turquesa", "marron", "vino", "crema", "aluminio", "plata", "oro", "bronce", "cobre", "teja", "ladrillo", "marfil", "champagne",
)
FINISHES = ("mate", "satinado", "satinada", "brillante", "semibrillante", "semimate")
CONNECTORS = ("macho", "hembra")

GALLON_FRACTIONS = {"1/4": "Cuarto", "1/2": "Medio galón", "1/8": "1/8 galón", "1/16": "1/16 galón", "1/32": "1/32 galón"}
PACKAGES = {
    "gal": "Galón", "galon": "Galón", "galones": "Galón", "gln": "Galón", "cuarto": "Cuarto", "cuartos": "Cuarto",
    "cubeta": "Cubeta", "cubetas": "Cubeta", "cub": "Cubeta", "litro": "Litro", "litros": "Litro", "lt": "Litro", "lts": "Litro",
    "oz": "Oz", "onza": "Oz", "onzas": "Oz", "ml": "ml", "kg": "kg", "lb": "lb", "libra": "lb", "libras": "lb", "g": "g",
}
PAINT = "Pinturas"

CONTEXT_WORDS = ("sala", "cocina", "bano", "cuarto", "dormitorio", "comedor", "casa", "apartamento", "cerca", "perimetral", "jardin", "patio", "interior", "exterior", "pared", "paredes")
# Concept, trigger words, categories allowed, words excluded, words of which one is required.
CONCEPTS = (
    ("piso_ceramico", ("azulejo", "azulejos", "baldosa", "baldosas"), ("Pisos",), (), ()),
    ("bloque_construccion", ("block", "bloque", "bloques"), ("Construcción", "Construccion"), (), ()),
    ("cemento_construccion", ("cemento",), ("Construcción", "Construccion"), (), ()),
    ("malla_cerca", ("malla",), ("Construcción", "Construccion"), (), ("cerca", "perimetral", "jardin", "patio")),
    ("pintura_pared", ("pintura",), ("Pinturas",), ("sellador",), ()),
)

NEGATIONS = ("sin", "no")
FORBIDDEN_FOR_PIECES = ("banos", "automotriz", "organizacion")
EXPECTED_CATEGORIES = {
    "puerta": ("puerta",), "ventana": ("ventana",), "pisos": ("piso", "ceramica", "porcelanato", "azulejo"),
    "muros_y_paredes": ("pared", "muro", "azulejo", "ceramica", "enchape"), "cielos": ("cielo", "gypsum", "durock"),
}

SECTION_WORDS = (
    ("Eléctrico", ("electricidad", "electrico")), ("Hidráulico", ("plomeria", "fontaneria", "griferia", "hidraulico")),
    ("Pintura", ("pinturas", "pintura")), ("Estructura", ("construccion", "estructura")), ("Acabados", ("pisos", "enchape", "maderas y puertas", "acabado")),
)
SECTIONS = ("Demolición", "Obra gris", "Cimentación", "Estructura", "Paredes", "Techo", "Eléctrico", "Hidráulico", "Acabados", "Pintura", "Sanitarios", "Otros")
NO_SECTION = "Sin partida"

CONFIDENCE_LEVELS = ("alta", "media", "baja")
