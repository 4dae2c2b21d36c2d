"""Names, identifiers and lookup tables the results depend on."""

# --- fixed values: markup -----------------------------------------------------
CATEGORY_PREFIX = "Category:"
INFOBOX_PREFIX = "infobox "
BIRTHS_SUFFIX = " births"
DEATHS_SUFFIX = " deaths"
GENERAL_WORDS = ("in", "of", "by")
COORDINATE_TEMPLATE_PREFIXES = ("coor", "geolinks")
COORDINATE_TEMPLATES_IGNORED = ("coord missing", "coord unknown")
PLACE_PARAMETERS = ("birth_place", "death_place")
MAX_TAG_CHARS = 256
MAX_NAME_CHARS = 1024

# --- fixed values: knowledge base ----------------------------------------------
HUMAN = "Q5"
EARTH = "Q2"
GENDER_MALE = "Q6581097"
GENDER_FEMALE = "Q6581072"
INSTANCE_OF = "P31"
DATE_OF_BIRTH = "P569"
DATE_OF_DEATH = "P570"
GENDER = "P21"
CITIZENSHIP = "P27"
COUNTRY_ALPHA2 = "P297"
PLACE_OF_BIRTH = "P19"
PLACE_OF_DEATH = "P20"
COORDINATES = "P625"
COUNTRY = "P17"
OCCUPATION = "P106"
FIELD_OF_WORK = "P101"
MANNER_OF_DEATH = "P1196"
IMAGE = "P18"
ARTICLE_ABOUT = "about"
ARTICLE_SITE = "isPartOf"
SITELINKS = "sitelinks"
LABEL = "label"
ENGLISH_SITE = "https://en.wikipedia.org/"

# --- fixed values: analysis ----------------------------------------------------
YEAR_MIN, YEAR_MAX = 1500, 2010
MIN_PEOPLE_PER_COUNTRY = 50
TOP_OCCUPATIONS = 10
BIRTH_CATEGORY_YEARS = (-2000, 2000)
FIRST_PLAUSIBLE_YEAR = 200
GENDER_WEIGHTS = {"he": 2, "his": 1, "him": 1, "she": -2, "her": -1}
FIRST_NAME_WEIGHT = 0.3
INFOBOX_VOTES = 3
COUNTRY_CODE_FIXES = {"France": "FRA", "Norway": "NOR"}
COUNTRY_TERMS = ("member states", "countries")
CITY_TERMS = ("populated places", "cities", "populated places established")
GAZETTEER_SIZE = 50_000
TOP_TITLES = 25
TOP_BY_VIEWS = 100

# --- fixed values: last word of a category -> field ---------------------------
FIELD_OF_WORD = """
footballers: sport
cricketers: sport
writers: art
lawyers: politics
journalists: art
historians: science
businesspeople: business
composers: art
artists: art
politicians: politics
poets: art
republicans: politics
translators: art
screenwriters: art
painters: art
academics: science
musicians: art
philanthropists: business
philosophers: science
democrats: politics
physicists: science
photographers: art
singer-songwriters: art
boxers: sport
mathematicians: science
novelists: art
economists: science
guitarists: art
inventors: science
actresses: art
songwriters: art
sculptors: art
botanists: science
essayists: art
educators: art
architects: art
diplomats: politics
generals: politics
pianists: art
illustrators: art
memoirists: art
organists: art
scientists: science
activists: politics
astronomers: science
engineers: science
biographers: art
chemists: science
singers: art
archaeologists: science
schoolteachers: art
psychologists: science
bankers: business
violinists: art
columnists: art
judges: politics
nobility: politics
socialists: politics
communists: politics
sociologists: science
comedians: art
anthropologists: science
zoologists: science
sportspeople: sport
billionaires: business
surgeons: science
engravers: art
geologists: science
explorers: science
jurists: politics
scholars: science
musicologists: art
entomologists: science
saxophonists: art
aviators: science
librarians: science
biologists: science
barristers: politics
revolutionaries: politics
drummers: art
cinematographers: art
printmakers: art
physicians: science
soldiers: politics
cardinals: politics
curators: art
cartoonists: art
chefs: business
choreographers: art
philologists: science
psychiatrists: science
djs: art
double-bassists: art
animators: art
actors: art
nationalists: politics
environmentalists: politics
naturalists: science
trumpeters: art
rappers: art
ornithologists: science
statisticians: science
biochemists: science
anarchists: politics
designers: art
geographers: science
merchants: business
directors: art
orientalists: science
sportswomen: sport
knights: politics
geneticists: science
dancers: art
neuroscientists: science
keyboardists: art
accountants: business
princesses: politics
dissidents: politics
trombonists: art
lyricists: art
ballerinas: art
folklorists: art
landowners: politics
satirists: art
paleontologists: science
multi-instrumentalists: art
muralists: art
jockeys: sport
watercolourists: art
pacifists: politics
businesswomen: business
investors: business
solicitors: politics
kickboxers: sport
exiles: politics
spies: politics
filmmakers: art
monarchists: politics
countesses: politics
cartographers: science
philatelists: science
decathletes: sport
magicians: art
conservationists: science
microbiologists: science
wrestlers: sport
anti-fascists: politics
fascists: politics
pharmacists: science
industrialists: business
podcasters: art
royalty: politics
tenors: art
mycologists: science
princes: politics
linguists: science
sportsmen: sport
neurologists: science
accordionists: art
meteorologists: science
ophthalmologists: science
clarinetists: art
ecologists: science
sportswriters: art
archivists: science
entertainers: art
admirals: business
psychoanalysts: science
astrologers: art

"""

# --- fixed values: infobox -> field --------------------------------------------
FIELD_OF_INFOBOX = """
artist: art
royalty: politics
person: art
officeholder: politics
scientist: science
military person: politics
writer: art
korean name: art
musical artist: art
architect: art
philosopher: science
president: politics
governor: politics
chinese: art
judge: politics
politician: politics
martial artist: art
economist: science
mp: politics
academic: science
cricketer: sport
state senator: politics
congressman: politics
indian politician: politics
boxer: sport
state representative: politics
sportsperson: sport
football biography: sport
professional wrestler: sport
comics creator: art
college coach: business
comedian: art
gaa player: sport

"""

def lookup_table(text: str) -> dict[str, str]:
    """``key: value`` lines as a dict."""
    pairs = (line.split(": ", 1) for line in text.splitlines() if line.strip())
    return {key: value.strip() for key, value in pairs}
