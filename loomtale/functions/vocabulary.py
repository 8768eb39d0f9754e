"""Word lists and patterns whose values decide results (fixed values)."""

# Headings of front and back matter.
HEADINGS = [
    r"agradecimientos?", r"acknowledg(?:e)?ments?", r"tabla de contenidos?", r"table of contents", r"contenido", r"contents",
    r"[ií]ndice", r"index", r"nota (?:de|del|de la) autor(?:a)?", r"author'?s note", r"palabras? (?:de|del|de la) autor(?:a)?",
    r"sobre (?:el|la) autor(?:a)?", r"about the author", r"dedicatoria", r"dedication", r"copyright", r"cr[eé]ditos?", r"credits?",
    r"reseñas?", r"reviews?", r"elogios? para", r"praise for", r"otros libros de", r"also by", r"bibliograf[ií]a", r"bibliography",
    r"glosario", r"glossary",
]

# Markers of a text's language.
SPANISH_MARKERS = ["el", "la", "los", "las", "que", "de", "en", "una", "con", "para", "como", "pero", "por", "del", "se", "no"]
ENGLISH_MARKERS = ["the", "and", "that", "of", "in", "to", "with", "for", "as", "but", "by", "from", "was", "were", "not"]
LANGUAGE_LABELS = {"es": "espanol", "en": "ingles"}
OTHER_LANGUAGE = "el mismo idioma de los datos del personaje"

# Titles in front of a name; the first pattern that matches counts.
TITLES = [
    r"^(sr\.?|sra\.?|señor|señora|señorita|don|doña)\s+",
    r"^(dr\.?|dra\.?|doctor|doctora|profesor|profesora)\s+",
    r"^(alcalde|alcaldesa|rey|reina|príncipe|princesa|capitán|capitana)\s+",
]

# Phrases that describe anybody, in normal form.
DESCRIPTIVE_FORMS = [
    "un hombre", "una mujer", "un nino", "una nina", "el hombre", "la mujer", "el nino", "la nina", "los hombres", "las mujeres",
    "los profesores", "las profesoras", "hombre", "mujer", "nino", "nina",
]
DESCRIPTIVE_CONNECTORS = ["que", "quien", "cuyo", "cuya", "cuyos", "cuyas", "donde"]
ARTICLES = ["el", "la", "los", "las", "un", "una", "unos", "unas"]

# Tokens that don't make a name substantial.
COMMON_NAME_TOKENS = [
    "a", "al", "ante", "bajo", "con", "contra", "de", "del", "desde", "durante", "e", "el", "ella", "en", "entre", "hacia", "hasta",
    "la", "las", "lo", "los", "mediante", "o", "para", "por", "segun", "sin", "sobre", "su", "sus", "tras", "tu", "tus", "un", "una",
    "unas", "unos", "y", "viejo", "vieja", "joven", "pequeno", "pequena", "grande", "alto", "alta", "baja", "rojo", "roja", "azul",
    "verde", "negro", "negra", "blanco", "blanca", "gris", "dorado", "dorada",
]
GENERIC_PERSONS = ["adulto", "adulta", "anciano", "anciana", "chico", "chica", "hombre", "joven", "mujer", "nino", "nina", "persona"]

# Card rules.
PLACEHOLDER_NAMES = ["", "unknown", "desconocido", "personaje", "character"]
PLURAL_ARTICLES = ["los", "las", "unos", "unas"]
SINGULAR_ARTICLES = ["el", "la", "un", "una"]
GENERIC_INDIVIDUALS = ["adulto", "adulta", "anciano", "anciana", "chico", "chica", "hombre", "joven", "muchacha", "muchacho", "mujer", "nina", "nino", "persona"]
GROUPS = [
    "aldeanos", "alumnos", "amigos", "ancianos", "chicos", "chicas", "ciudadanos", "companeros", "criadas", "criados", "familia",
    "familiares", "gente", "grupo", "guardias", "hombres", "invitados", "jovenes", "maestros", "muchachas", "muchachos", "mujeres",
    "ninas", "ninos", "padres", "personas", "profesores", "sirvientes", "soldados", "vecinos",
]

# Identity types from the weakest, and limits.
IDENTITY_TYPES = ["title", "specific_appellation", "alias", "name"]
AUTO_MERGE, REVIEW = 0.90, 0.60
FILE_TYPES = ["txt", "pdf", "epub", "doc", "docx"]
MAX_UPLOAD_BYTES, MIN_TEXT_CHARS, MAX_PROMPT_CHARS, MIN_PROMPT_WORDS = 104_857_600, 500, 4000, 5
