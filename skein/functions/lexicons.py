"""Word lists and tables of event curation. Fixed values, in the order in which they are tried; a user may pass other ones."""

#: Words and phrases of military matters.
MILITARY = (
    "missile", "ballistic", "cruise missile", "shelling", "artillery", "troop movement", "troop buildup", "troop build-up", "redeploy",
    "redeployment", "mobilization", "mobilisation", "incursion", "cross-border", "staging area", "military drill", "live-fire", "war game",
        "brigade",
    "battalion", "militia", "armed forces", "military", "air force", "air defense", "surface-to-air", "airbase", "base commander", "sortie",
    "munitions", "arms shipment", "weapons transfer", "defense ministry", "ministry of defence", "general staff", "special forces",
        "paratrooper",
    "border guard", "rocket force", "naval task force", "fleet command", "forward deployed", "combat readiness", "battle group",
    "carrier strike group", "destroyer squadron", "frigate squadron", "air-defence", "air defence", "combat drone", "fighter squadron",
    "naval exercise", "joint exercise", "field exercise", "warships", "warship", "submarine patrol", "military army", "national army",
        "rebel army",
    "military navy", "naval", "military radar", "radar system", "military deployment", "troop deployment", "us marines", "royal marines",
    "marine corps",
)
#: Civilian matters.
CIVILIAN_NOISE = (
    "taxi", "uber", "bus", "rail", "train", "student", "teacher", "hospital", "doctor", "farmers", "football", "basketball", "concert",
        "festival",
    "celebrity", "tourism", "real estate", "sushi", "burger", "cafe", "café", "restaurant reopens", "shop reopens", "gems to discover",
        "missed shop",
    "food guide", "recipe", "hospice", "palliative", "oncology", "obstetric", "maternity ward", "nursing home", "elderly care",
        "care for elderly",
    "care for the elderly", "retirement home", "care home", "old age home", "senior center", "senior centre", "geriatric",
        "old people home",
    "home for elderly", "home for the elderly", "social welfare", "welfare center", "charity opens", "free clinic", "free hospital",
    "celebrity divorce", "celebrity couple", "pop star", "singer arrested", "weather forecast", "flood warning", "earthquake damage",
    "workers strike", "labor dispute", "labour dispute", "union strike", "wage dispute", "workers demand", "dockworkers", "longshoremen",
    "transport strike", "healthcare strike", "teachers strike", "nurses strike", "workers protest wages", "union negotiation",
        "industrial action",
    "collective bargaining", "work stoppage", "robbery", "burglary", "theft", "shoplifting", "carjacking", "drive-by shooting",
        "gang shooting",
    "gang related", "gang activity", "workplace violence", "school shooting", "office shooting", "drug bust", "drug trafficking arrest",
    "drug seizure", "industrial accident", "construction accident", "workplace accident", "factory fire", "factory incident",
        "assembly line",
    "mine collapse", "hotel", "motel", "inn", "lodge", "hostel", "airbnb", "acidente", "veiculos", "tombado", "khospisc", "khosp",
        "vrachei",
    "bolnitsa", "rozwod", "slub", "wesele", "ristorante", "cucina", "ricetta", "receta", "cocina", "boda", "murder", "homicide",
        "killed wife",
    "killed husband", "couple arrested", "domestic violence", "family dispute", "child abuse", "parents murdered", "femicide",
        "kidnapped child",
    "serial killer", "body found", "cadaver", "stock market", "earnings report", "quarterly results", "investing", "samsung",
        "semiconductor",
    "memory chips", "bitcoin", "cryptocurrency", "crypto exchange", "court rules", "lawsuit", "class action", "plea deal", "anniversary",
    "memorial service", "fact check", "opinion column", "op-ed",
)
#: De-escalation.
CALMING = (
    "ceasefire", "truce", "peace talks", "negotiation", "negotiations", "mediation", "agreement",
)
#: Titles and addresses that are no events at all.
NOISE = (
    "photo review", "fashion", "celebrity", "movie", "film", "music", "festival", "sports", "football", "soccer", "nba", "nfl", "concert",
    "entertainment", "lifestyle", "recipe", "restaurant", "tourism", "travel", "stock", "market", "earnings", "real estate", "shopping",
        "ipo",
    "startup", "revenue", "investment", "shares", "samsung", "semiconductor", "memory chips", "acciones", "bolsa", "inversion",
    "inteligencia artificial", "court rules", "lawsuit", "anniversary", "memorial service", "fact check", "opinion:", "birth", "delivery",
        "triplets",
    "twins", "pregnant", "pregnancy", "mother", "maternity", "hospital", "obstetric", "nursing home", "elderly care", "retirement home",
        "care home",
    "old age home", "geriatric", "social welfare", "car accident", "road accident", "plane crash", "train derail", "building collapse",
        "flood kills",
    "storm kills", "weather kills", "quiz politics", "columnist", "op-ed", "opinion column", "celeb", "radaronline", "burger king",
        "fast food fire",
    "sushi shop", "japanese gems", "wine bar", "shop reopens", "café reopens", "reopens plus", "gems to discover", "hospice care",
        "deficit ukhoda",
    "khospisc", "celebrity singer", "celebrity chef", "pop singer", "reality show", "fire burger", "local fire", "house fire",
        "apartment fire",
    "acidente entre", "carro tombado", "veiculos deixa", "defitcit ukhoda", "ne khvataet vrachei", "prokuror zaprosila", "byvshego muzha",
    "sone shop", "index id news sc", "faits-divers", "/faits_divers/", "petroleo sube", "petróleo sube", "precio del petroleo",
        "precio del petróleo",
    "precio petroleo", "precio petróleo", "petroleo baja", "petróleo baja", "petroleo alcanza", "petróleo alcanza", "barril de petroleo",
    "barril de petróleo", "oil prices rise", "oil prices fall", "oil prices climb", "oil prices drop", "crude oil rises", "crude oil falls",
    "brent rises", "brent falls", "brent crude hits", "wti rises", "wti falls", "oil hits", "barrel hits", "oil surges", "prix du petrole",
    "prix du pétrole", "precio del gas", "gas prices rise", "gold prices", "gold surges", "gold falls", "court rules", "court ruling",
        "court order",
    "sentenced to", "found guilty", "jury verdict", "verdict in", "convicted of", "acquitted", "indicted", "pleaded guilty", "plea deal",
    "class action", "lawsuit filed", "sued for", "tribunal correctionnel", "cour de cassation", "mis en examen", "bitcoin",
        "cryptocurrency",
    "blockchain", "crypto market", "crypto exchange", "nft", "defi", "ethereum", "bear attack", "shark attack", "alligator attack",
        "snake bite",
    "dog attack", "wolf attack", "animal attack", "wild animal", "school board", "curriculum", "university campus", "tuition",
        "vaccination campaign",
    "covid cases", "pandemic response", "mortgage rate", "housing market", "property prices", "home sales", "real estate market",
        "rent prices",
    "software update", "app update", "software release", "tech company", "software deployment", "cloud deployment", "code deployment",
)
#: Civilian matters whatever else is said.
CIVILIAN_OVERRIDE = (
    "clinical trial", "patient", "vaccine", "cancer", "therapy", "hospital", "birth", "delivery", "triplets", "twins", "pregnant",
        "pregnancy",
    "mother", "maternity", "obstetric", "election result", "ballot count", "parliament session", "economic growth", "gdp", "inflation",
    "interest rate", "trade deal", "stock market", "share price", "earnings", "revenue", "profit", "earthquake damage", "flood damage",
    "hurricane damage", "wildfire", "car accident", "road accident", "plane crash", "train derail", "sports", "tournament", "championship",
        "concert",
    "movie",
)
#: Security matters that outweigh civilian words.
SECURITY_OVERRIDE = (
    "airstrike", "missile", "drone strike", "military", "armed conflict", "terror attack", "terrorist", "terrorism", "car bomb",
        "suicide bomb",
    "hostage", "shelling", "cyberattack", "ransomware", "coup", "martial law", "bombardment", "gunfire", "artillery", "armed forces",
        "air force",
    "warship", "fighter jet", "ballistic", "nuclear weapon", "chemical weapon",
)
#: Domestic security.
DOMESTIC = (
    "faa", "sheriff", "county", "police department", "police chief", "state trooper", "highway patrol", "district attorney", "court filing",
    "organized crime", "gang unit", "local police", "border patrol", "county jail", "public safety", "police commissioner",
        "municipal corporation",
    "city council", "district court", "lokayukta", "demolition drive",
)
#: Local administration.
LOCAL_ADMINISTRATION = (
    "drug abuse", "atm machine stolen", "demolitions", "illegal terrace", "contracts irregularities", "public works contract",
        "municipal tender",
    "urban development authority", "police station", "district administration", "civic body", "encroachment drive", "property dispute",
    "cordon and search operation", "local murder case", "couple arrested", "civil dispute", "near san antonio", "parents of a woman",
    "otra forma de morir",
)
#: Civil crime.
CIVIL_CRIME = (
    "murder", "double murder", "homicide", "femicide", "domestic violence", "couple arrested", "parents of a woman", "body in closet",
    "family murder", "serial killer", "stabbed to death", "shot dead in home", "civil crime", "san antonio", "otra forma de morir",
    "murder of parents", "braquage", "cambriolage", "casse rate", "casse de banque", "vol a main armee", "hold-up", "gang de braqueurs",
    "juge en correctionnelle", "jugé en correctionnelle", "condamné par le tribunal", "condamne par le tribunal", "faits divers",
        "faits-divers",
    "atraco al banco", "robo de banco", "robo a mano armada", "asalto al banco", "juzgado por", "condenado por",
)
#: World matters that outweigh domestic, local and criminal ones.
GLOBAL_OVERRIDE = (
    "pentagon", "nato", "iran", "israel", "russia", "ukraine", "china", "taiwan", "north korea", "south china sea", "red sea", "hormuz",
        "military",
    "navy", "air force", "missile", "warship", "fighter jet", "drone", "spacecraft", "satellite",
)
#: Business, as parts of words.
BUSINESS = (
    "stock", "market", "earnings", "revenue", "profit", "loss", "shares", "share price", "analyst forecast", "quarterly results",
        "investing",
    "investment", "samsung", "semiconductor", "semiconductors", "memory chips", "chip demand", "artificial intelligence demand",
        "acciones", "bolsa",
    "inversion", "inversión", "resultados", "beneficio", "crece", "crecimiento", "esperado", "demanda", "chips de memoria",
        "inteligencia artificial",
    "waterbomber", "water bomber", "flight deck certified", "avionics certified", "certified for", "faa certified", "easa certified",
    "type certificate", "air tanker", "fire bomber", "firefighting aircraft", "cl-415", "cl415", "insight flight deck", "cockpit upgrade",
    "avionics upgrade",
)
#: Medicine, as parts of words.
MEDICAL = (
    "hospital", "birth", "delivery", "delivered", "triplets", "twins", "pregnant", "pregnancy", "mother", "mothers", "maternity",
        "obstetric",
    "high risk mother", "high-risk mother", "이대목동병원", "병원", "세쌍둥이", "출산", "산모", "고위험",
)
#: Security, as parts of words.
SECURITY = (
    "war", "attack", "airstrike", "strike", "missile", "drone", "military", "army", "navy", "troops", "terror", "terrorism", "hostage",
        "bomb",
    "explosion", "coup", "riot", "protest", "sanction", "border", "cyberattack", "ransomware", "hack", "espionage", "export ban",
        "arms embargo",
)
#: Hosts without events.
NOISE_DOMAINS = (
    "espn.com", "bleacherreport.com", "nba.com", "nfl.com", "mlb.com", "tmz.com", "people.com", "eonline.com", "variety.com",
        "foodnetwork.com",
    "allrecipes.com", "techcrunch.com", "engadget.com", "theverge.com", "marketwatch.com", "investopedia.com", "fool.com",
    "estrategiasdeinversion.com",
)
#: Hosts whose events need a strong code.
LOW_QUALITY_DOMAINS = (
    "dailytrib.com", "amren.com", "bearingarms.com", "nydailynews.com", "inquirer.com", "ksl.com", "norfolkdailynews.com", "patch.com",
    "winnipegfreepress.com", "radaronline.com", "zazoom.it", "inewsgr.com",
)
#: Hosts that are never taken.
REJECTED_DOMAINS = (
    "zazoom.it", "inewsgr.com",
)
#: Category, beginnings of event codes, and words (as parts of words) that mean it.
CATEGORIES = (
    ("terrorism", ("181", "1831", "1832", "1833",), ("terrorist", "terrorism", "isis", "al qaeda", "boko haram", "suicide bombing", "ied",
            "car bomb", "hostage taking",)),
    ("cyber", ("155",), ("cyberattack", "cyber attack", "ransomware", "hacked", "hackers", "malware", "ddos", "cyber forces",)),
    ("protest", ("14",), ("mass protest", "violent protest", "anti-government protest", "demonstration", "civil unrest", "political unrest",
        )),
    ("strategic", ("13", "16", "17",), ("sanctions imposed", "nuclear program", "nuclear weapon", "ballistic missile", "hypersonic", "wmd",
            "diplomatic rupture", "diplomatic crisis", "arms embargo", "export ban",)),
    ("conflict", ("18", "19", "20",), ("armed clashes", "fighting", "armed combat", "rebels", "militia", "military offensive", "siege",
            "insurgent", "guerrilla",)),
    ("military", ("15", "180", "184", "185", "186", "190", "193", "194", "195", "196", "204",),
        ("airstrike", "missile", "artillery", "shelling", "bombardment", "warplane", "fighter jet", "military aircraft", "drone strike",
            "armed forces", "military exercise", "troops", "mobilization", "naval", "submarine", "warship",)),
    ("crisis", ("13", "16", "17",), ("diplomatic expulsion", "political crisis", "martial law", "mass evacuation", "refugee crisis",
            "ultimatum", "diplomatic tension", "border incident", "border clash",)),
    ("incident", (), ("security incident", "police operation", "checkpoint",)),
)
#: Points of hosts, a third of which is added to a score, 20 at most.
HOST_POINTS = {
    "tass.ru": 65, "tass.com": 65, "ria.ru": 60, "rt.com": 55, "sputniknews.com": 55, "sputnikglobe.com": 55, "interfax.ru": 60,
        "xinhuanet.com": 65,
    "news.cn": 65, "globaltimes.cn": 60, "chinadaily.com.cn": 55, "cgtn.com": 55, "china.org.cn": 55, "kcna.kp": 70, "kcna.co.jp": 70,
    "rodong.rep.kp": 70, "presstv.ir": 60, "presstv.com": 60, "irna.ir": 60, "tasnimnews.com": 60, "farsnews.ir": 55, "mehrnews.com": 55,
    "almayadeen.net": 55, "aljazeera.net": 50, "alarabiya.net": 50, "yonhapnews.co.kr": 55, "mil.ru": 70, "iz.ru": 60, "kommersant.ru": 60,
    "vedomosti.ru": 55, "rbc.ru": 55, "fontanka.ru": 55, "meduza.io": 55, "novayagazeta.ru": 55, "people.com.cn": 65, "pla.cn": 70,
        "mod.gov.cn": 70,
    "guancha.cn": 60, "mil.news.sina.com.cn": 65, "thepaper.cn": 55, "huanqiu.com": 60, "chosun.com": 55, "joongang.co.kr": 55,
    "koreatimes.co.kr": 55, "asahi.com": 55, "yomiuri.co.jp": 55, "nikkei.com": 55, "nhk.or.jp": 60, "iranintl.com": 60, "aa.com.tr": 55,
    "ahvalnews.com": 55, "rferl.org": 60, "kavkazr.com": 55, "currenttime.tv": 55, "kyivindependent.com": 60, "ukrinform.ua": 60,
        "pravda.com.ua": 55,
}
#: Country codes of the feed to two-letter codes, where they differ.
FEED_TO_ISO = {
    "UP": "UA", "RS": "RU", "EI": "IE", "WE": "PS", "IZ": "IQ", "IS": "IL", "CH": "CN", "KS": "KR", "KN": "KP", "SU": "SD", "YM": "YE",
        "VM": "VN",
    "LE": "LB", "GM": "DE", "UK": "GB", "SP": "ES", "PO": "PT", "AU": "AT", "AS": "AU", "SW": "SE", "DA": "DK", "IC": "IS", "EN": "EE",
        "LG": "LV",
    "LH": "LT", "AJ": "AZ", "GG": "GE", "MO": "MA", "TU": "TR", "EZ": "CZ", "SN": "SG", "RI": "RS", "BO": "BY",
}
