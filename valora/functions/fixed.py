"""Fixed values of the domain: word lists, label maps, patterns and thresholds.

Every value here is fixed: results depend on it being exactly this.
"""

# --- fixed values: price window and prices -------------------------------------------------
PRICE_FLOOR = 4500.0
PRICE_CAP = 500_000.0
EARTH_RADIUS_KM = 6371.0
DEFAULT_AGE_DAYS = 22
DEFAULT_ANCHOR = 25_000.0

# --- fixed values: property types ----------------------------------------------------------
TYPE_MAP = {
    "departamento": "departamento",
    "loft": "departamento",
    "penthouse": "departamento",
    "casa": "casa",
    "oficina": "oficina",
    "local": "local_comercial",
    "local comercial": "local_comercial",
    "tienda / local comercial": "local_comercial",
    "tienda/local comercial": "local_comercial",
    "bodega": "bodega_industrial",
    "nave industrial / bodega": "bodega_industrial",
    "nave industrial/bodega": "bodega_industrial",
    "nave industrial": "bodega_industrial",
    "terreno": "terreno",
    "lote / terreno": "terreno",
    "lote/terreno": "terreno",
    "edificio": "edificio",
    "edificio mixto": "edificio",
    "edificio comercial": "edificio",
    "consultorio médico": "consultorio",
    "consultorio": "consultorio",
}
TYPE_RULES = [
    ("departamento", ["departamento", "depto", "depa", "apartamento", "piso"]),
    ("casa", ["casa", "residencia", "chalet"]),
    ("oficina", ["oficina"]),
    ("local_comercial", ["local", "comercial", "tienda", "plaza"]),
    ("bodega_industrial", ["bodega", "nave", "industrial", "almacén"]),
    ("terreno", ["terreno"]),
    ("estudio", ["estudio"]),
]
TYPE_LABELS = {
    "departamento": "Departamento",
    "casa": "Casa",
    "oficina": "Oficina",
    "local_comercial": "Local comercial",
    "bodega_industrial": "Bodega industrial",
    "terreno": "Terreno",
}
QUESTION_TYPES = {
    "departamento": "departamento",
    "casa": "casa",
    "oficina": "oficina",
    "local_comercial": "local comercial",
    "bodega_industrial": "bodega",
}
STATES = [
    "nuevo león", "jalisco", "ciudad de méxico", "cdmx", "estado de méxico",
    "querétaro", "coahuila", "chihuahua", "sonora", "tamaulipas",
]

# --- fixed values: who advertises ----------------------------------------------------------
OWNER_WORDS = ["propietario", "particular", "dueño", "owner", "directo"]
AGENCY_WORDS = ["inmobiliaria", "agencia", "bienes raíces", "realty"]

# --- fixed values: attribute patterns ------------------------------------------------------
NUM_M2 = r"(\d+(?:\.\d+)?)\s*m²"
NUM_ROOMS = r"(\d+)\s*rec"
NUM_BATHS = r"(\d+(?:\.\d+)?)\s*ba"
NUM_PARKING = r"(\d+)\s*estac"
TEXT_M2 = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*m[²2]"
TEXT_ROOMS = r"(?i)(\d+)\s*(?:rec[áa]?maras?|habitaciones?|cuartos?|dormitorios?)"
TEXT_BATHS = r"(?i)(\d+(?:\.\d+)?)\s*ba[ñn]os?"
TEXT_PARKING = r"(?i)(\d+)\s*(?:caj[oó]n(?:es)?|estacionamiento|parking|garaje|cochera)"
PHONE = (
    r"\b(?:\+?52[-.\s]?)?(?:\(?\d{2,3}\)?[-.\s]?)?\d{4}[-.\s]?\d{4}\b"
    r"|\b\d{10}\b"
    r"|\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"
)
FLOOR_PATTERNS = [r"(?i)piso\s*(\d+)", r"(?i)nivel\s*(\d+)", r"(?i)(\d+)o\s*piso"]
LISTING_ID = r"/detalle/(.+)$"
PROPERTY_LINK = r"(?i)/(propiedad|inmueble|departamento|casa|oficina)-\d+"

# --- fixed values: amenity words -----------------------------------------------------------
TAG_FLAGS = {
    "pill_gym": ["gimnasio"],
    "pill_pool": ["alberca"],
    "pill_garden": ["jardín"],
    "pill_security": ["circuito cerrado"],
    "pill_elevator": ["elevador"],
    "pill_terrace": ["terraza"],
    "pill_rooftop": ["rooftop"],
    "pill_playground": ["área de juegos"],
}
TEXT_AMENITIES = [
    "alberca", "gimnasio", "estacionamiento", "balcón", "terraza",
    "jacuzzi", "pet", "amueblado", "bodega", "vigilancia", "seguridad",
    "coworking", "rooftop", "asador", "lavadora", "secadora",
    "aire acondicionado", "refrigerador", "microondas", "elevador",
    "portero", "cisterna", "gas", "internet", "cancha", "pádel",
]
QUESTION_AMENITIES = ["alberca", "gimnasio", "elevador", "terraza", "rooftop", "jardín", "seguridad"]
TOKEN_STOPWORDS = [
    "para", "calle", "zona", "renta", "depa", "tipo", "rento",
    "departamento", "casa", "desde", "entre", "metros", "cuadros",
    "cuenta", "cerca", "todo", "solo", "este", "esta", "más",
]
CLOUD_STOPWORDS = [
    "de", "la", "el", "en", "y", "a", "los", "las", "con", "por", "para", "se",
    "que", "un", "una", "es", "su", "del", "al", "lo", "más", "son", "como",
    "todo", "esta", "este", "entre", "cada", "muy", "hay", "sus", "nos",
    "también", "sin", "sobre", "está", "tiene", "pero", "si", "no", "le",
    "ya", "así", "ser", "fue", "puede", "han", "ha", "o", "e",
]

# --- fixed values: segments by text --------------------------------------------------------
KW_STUDENT = r"estudiante|universitari|tec |tecnológico|tecnologico|itesm|uanl|udem|campus"
KW_ACCESS = r"elevador|ascensor|planta baja|sin escalera|rampa|accesib"
KW_SECURITY = r"seguridad 24|vigilancia 24|portero|guardia"
KW_QUIET = r"tranquilo|tranquila|silencioso|silenciosa"
STUDENT_SIGNALS = {
    "estudiante": r"estudiante",
    "tecnologico": r"tec |tecnológico|tecnologico",
    "uanl": r"uanl",
    "itesm": r"itesm",
    "udem": r"udem",
    "universitario": r"universitari",
    "comparte": r"comparte",
    "coworking": r"coworking",
    "cuarto": r"cuarto",
}
SENIOR_SIGNALS = {
    "elevador": r"elevador|ascensor",
    "planta_baja": r"planta baja",
    "seguridad_24h": r"seguridad 24|vigilancia 24",
    "tranquilo": r"tranquilo|tranquila",
    "guardia": r"guardia|portero",
    "accesible": r"accesib|rampa",
    "silencioso": r"silencioso|silenciosa",
}
KW_RULE_STUDENT = (
    r"estudiante|universitari|tec\b|tecnol[oó]gico|itesm|uanl|udem|campus|"
    r"roomie|comparte\s+cuarto|cuarto\s+en\s+renta|coworking|zona\s+estudiantil|"
    r"cerca.*universidad|universidad.*cerca"
)
KW_RULE_ACCESS = r"elevador|ascensor|planta\s+baja|sin\s+escalera|rampa|accesib|sin\s+escalon"
KW_RULE_SECURITY = r"seguridad\s+24|vigilancia\s+24|portero|guardia|caseta|c[aá]mara"
KW_RULE_QUIET = r"tranquil[ao]|silencios[ao]|privado|residencial\s+privado|zona\s+residencial"
KW_RULE_COMFORT = r"jardín|jardin|patio|área\s+verde|[aá]rea\s+verde"
RESIDENTIAL = ["casa", "departamento", "loft", "cuarto"]
PRICE_STUDENT_MAX = 18_000.0
PRICE_SENIOR_MIN = 8_000.0
PRICE_SENIOR_MAX = 35_000.0

# --- fixed values: words of the lead score profiles ----------------------------------------
SCORE_STUDENT = r"estudiante|universitari|tec |tecnológico|tecnologico|itesm|uanl|udem|campus|college"
SCORE_SENIOR = r"tranquilo|tranquila|silencio|seguro|segura|privada|privado|adulto mayor|pensionado"
SCORE_RELOCATION = (
    r"ejecutivo|corporativo|expat|relocation|internacional|vista|penthouse|premium|exclusivo|lujo"
)

# --- fixed values: zones -------------------------------------------------------------------
ZONES_PREMIUM = [
    "valle oriente", "santa bárbara", "cumbres", "haciendas de la sierra",
    "del valle", "carrizalejo", "cumbres elite", "residencial santa bárbara",
]
ZONES_MIDDLE = [
    "contry", "roma", "mitras", "obispado", "san pedro garza garcía",
    "del paseo residencial", "tecnológico", "loma linda",
]
ZONES_RELOCATION = [
    "Valle Oriente", "Obispado", "San Pedro Garza García", "Del Paseo Residencial",
    "Colinas de San Jerónimo", "Cumbres", "Lomas de San Francisco",
    "Cumbres del Sol", "Loma Larga", "Contry",
]

# --- fixed values: points of interest ------------------------------------------------------
POI_CATEGORIES = {
    "gym": ["Centros de acondicionamiento físico"],
    "spa_belleza": ["Salones y clínicas de belleza"],
    "banco": ["Banca", "Casas de bolsa", "Instituciones de crédito"],
    "hotel": ["Hoteles", "Moteles"],
    "clinica_priv": ["Consultorios de medicina", "sector privado"],
    "restaurante": ["Restaurantes", "Cafeterías", "fuentes de sodas"],
    "cafe": ["Cafeterías", "fuentes de sodas", "neverías"],
    "supermercado": ["Supermercados", "minisupers", "abarrotes"],
    "farmacia": ["Farmacias"],
    "escuela_priv": ["sector privado", "Escuelas de educación"],
    "universidad": ["Instituciones de educación superior", "Universidades"],
    "plaza_comercial": ["Centros comerciales", "Plazas comerciales"],
    "tienda_depto": ["Tiendas departamentales"],
}
POI_RADII_KM = [0.5, 1.0]

# --- fixed values: default model inputs ----------------------------------------------------
FEATURE_DEFAULTS = {
    "m2": 85.0, "recamaras": 2.0, "banos": 2.0, "estacionamientos": 1.0,
    "lat": 25.65, "lon": -100.30, "userviews": 25.0, "days_listed": 22.0,
}

# --- fixed values: question parsing --------------------------------------------------------
TOPIC = (
    r"(?i)rent|alquil|depart|casa|cuarto|habitaci|propiedad|inmueble|precio|costo|cuesta|"
    r"colonia|municipio|m2|m²|rec[aá]mara|ba[ñn]o|zona|fraccionamiento|"
    r"monterrey|san pedro|garza garc|guadalupe|apodaca|escobedo|santa catarina|"
    r"m[eé]rida|yucat|nuevo le[oó]n"
)
Q_ZONE = r"en\s+([A-ZÁÉÍÓÚÜÑa-záéíóúüñ][A-ZÁÉÍÓÚÜÑa-záéíóúüñ\s\(\)]+?)(?:,|\.|con|\d)"
Q_ZONE_LAZY = r"(?iu)en\s+((?:[a-záéíóúüñ\(\)]+\s?){1,4}?)(?=\s*(?:,|\.|con\s|\d|\?|$))"
Q_M2 = r"(?i)(\d+)\s*m[²2]"
Q_ROOMS = r"(?i)(\d+)\s*rec[áa]mara"
Q_BATHS = r"(?i)(\d+(?:\.\d)?)\s*ba[ñn]o"
Q_PARKING = r"(?i)(\d+)\s*estacionamiento"
Q_LUXURY = r"(?i)lujo|luxury|premium"
Q_FURNISHED = r"(?i)amueblad"
Q_NEW = r"(?i)nuevo|nueva"
NUMBER_WORDS = {"un": 1, "una": 1, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6}

# --- fixed values: price answers (patterns in order, bounds, bounds inclusive?) ------------
ANSWER_PROFILES = {
    "strict": (
        [
            r"(?im)^\s*\$?\s*([\d,]+(?:\.\d+)?)\s*$",
            r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:MXN|pesos)?",
            r"(?i)([\d,]+(?:\.\d+)?)\s*(?:MXN|pesos)",
            r"\b([\d]{4,6})\b",
        ],
        3_000, 150_000, True,
    ),
    "estimate": (
        [
            r"(?i)es\s+\*{0,2}\$\s*([\d,]+(?:\.\d+)?)",
            r"(?i)estimado[^\$]*\$\s*([\d,]+(?:\.\d+)?)",
            r"(?i)estim[ao][^\$]*\$\s*([\d,]+(?:\.\d+)?)",
            r"(?i)precio[^$\n]*\$\s*([\d,]+(?:\.\d+)?)\s*(?:MXN|/mes)",
            r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:MXN|pesos|/mes|mensual)",
        ],
        1_000, 500_000, False,
    ),
    "seed": (
        [
            r"(?i)estimado\S*\s+es\s+\$\s*([\d,]+)",
            r"(?i)precio\s+\$\s*([\d,]+)",
            r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*MXN",
            r"(?i)([\d,]+(?:\.\d+)?)\s*(?:MXN|pesos)",
            r"\b(\d{4,6})\b",
        ],
        1_000, 500_000, True,
    ),
    "loose": (
        [
            r"(?i)\$\s*([\d,]+(?:\.\d+)?)",
            r"(?i)([\d,]+(?:\.\d+)?)\s*(?:MXN|pesos)",
            r"\b(\d{4,6})\b",
        ],
        3_000, 200_000, True,
    ),
    "anchor": (
        [
            r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(?:MXN|pesos|al mes|mensual|/mes)",
            r"(?i)([\d,]+(?:\.\d+)?)\s*(?:MXN|pesos)\s*(?:al mes|mensual|/mes)",
            r"(?i)precio[^:]*:\s*\$?\s*([\d,]+)",
            r"(?i)renta[^:]*:\s*\$?\s*([\d,]+)",
            r"(?i)\$\s*([\d,]{4,})",
        ],
        3_000, 150_000, True,
    ),
}

# --- fixed values: extraction record (name -> lowest, highest, integer?) -------------------
EXTRACTION_NUMBERS = {
    "area_m2": (5.0, 50_000.0, False),
    "bedrooms": (0.0, 20.0, True),
    "bathrooms": (0.5, 20.0, False),
    "parking": (0.0, 50.0, True),
    "floor": (0.0, 100.0, True),
    "price_per_m2_desc": (None, None, False),
    "maintenance_fee": (None, None, False),
}
EXTRACTION_FLAGS = [
    "furnished", "has_pool", "has_gym", "has_elevator", "has_terrace",
    "has_rooftop", "has_garden", "has_security_24h", "has_lobby",
    "has_sala_juntas", "has_coworking", "has_bodega", "has_minisplit_ac",
    "has_heating", "has_cistern", "is_new_construction", "allows_pets",
    "has_service_room",
]
BATCH_KEYS = ["results", "properties", "items", "data"]

# --- fixed values: page records ------------------------------------------------------------
JSONLD_TYPES = ["Apartment", "House", "RealEstateListing", "Product", "Offer"]
DETAIL_TYPES = ["Apartment", "House", "RealEstateListing", "Product"]

# --- fixed values: texts of questions, examples and prompts --------------------------------
QUESTION_TEMPLATES = [
    "Tengo un {tipo} en {colonia}, {municipio}. Tiene {rec} recámaras, {ban} baños y {m2}. {extras}¿Cuánto cuesta de renta mensual?",
    "¿Cuánto debería costar de renta un {tipo} de {rec} recámaras en {colonia}? Superficie: {m2}. {extras}",
    "Busco rentar un {tipo} en {colonia}, {municipio}. {rec} recámaras, {m2}, {extras}¿Cuál es el precio de mercado?",
    "Dame un estimado de renta para: {tipo} en {colonia}, {rec} rec, {ban} baños, {m2}. {extras}",
    "Un {tipo} en {colonia} con {rec} recámaras y {m2}. {extras}¿Cuánto vale la renta?",
]
EXAMPLE_SYSTEM = (
    "Eres un experto en el mercado inmobiliario de renta en Monterrey, Nuevo León. "
    "Conoces a fondo las colonias, rangos de precios por zona, y el efecto de "
    "amenidades y características sobre el valor de renta. Siempre respondes en español, "
    "con argumentos concretos basados en el mercado local."
)
EXAMPLE_QUESTIONS = [
    "¿Cuál es el precio de renta estimado para esta propiedad y por qué?",
    "¿Cuánto debería costar de renta mensual esta propiedad en el mercado actual?",
    "Analiza esta propiedad y estima su precio de renta.",
    "¿Es razonable el precio de esta propiedad? ¿Cuánto estimarías tú?",
    "Dame un estimado de renta para esta propiedad con tu justificación.",
]
PRICE_BANDS = [
    (10_000.0, ""),
    (20_000.0, " (segmento económico-medio)"),
    (30_000.0, " (segmento medio)"),
    (45_000.0, " (segmento medio-alto)"),
    (None, " (segmento alto/lujo)"),
]
ZONE_TEXT = {
    "premium": " es una de las zonas premium de Monterrey, con alta demanda y precios elevados.",
    "media": " es una zona consolidada de clase media-alta en Monterrey.",
    "otra": " es una colonia de Monterrey con mercado de renta activo.",
}
M2_TIERS = [(300.0, "alto"), (150.0, "razonable"), (None, "accesible")]
CHAT_TEMPLATES = {
    "chatml": ("<|im_start|>system\n", "<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "llama3": (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n",
        "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n",
        "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    ),
    "mistral": ("<s>[INST] ", "\n\n", " [/INST]"),
    "chatml_bos": (
        "<s><|im_start|>system\n",
        "<|im_end|>\n<|im_start|>user\n",
        "<|im_end|>\n<|im_start|>assistant\n",
    ),
}

# --- fixed values: places and geometry -----------------------------------------------------
CITY_CENTER = (25.6866, -100.3161)
MAIN_AVENUE_LAT = 25.65
KM_PER_DEGREE = 111.0
