"""They define results and must be exactly these."""

ENTITY_TYPES = [
    "PERSON", "EMAIL", "PHONE", "CREDIT_CARD", "SSN", "IBAN", "IP_ADDRESS", "LOCATION", "ORGANIZATION", "ADDRESS", "URL", "USERNAME",
    "PASSWORD", "BANK_ACCOUNT", "DATE", "MISC",
]

# Recognisers in order: (type, pattern, base score). \d, \s and \b are Unicode-aware, hence (?U).
EMAIL = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = (
    r"(?U)(?:\+\d{1,3}[\s\-.]?\(?\d{1,4}\)?[\s\-.]?\d{1,4}[\s\-.]?\d{1,9}"
    r"|\(\d{2,5}\)[\s\-.]?\d{2,4}[\s\-.]?\d{2,9}"
    r"|\b\d{2,4}[\s\-.]\d{2,4}[\s\-.]\d{2,9}\b"
    r"|\b\d{2,5}[\s\-.]\d{6,12}\b)"
)
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
CREDIT_CARD = r"(?U)\b(?:\d{4}[\s\-]?){3}\d{4}\b"
IP_ADDRESS = r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
IBAN = r"(?U)\b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?(?:[\dA-Z]{4}[\s]?){1,7}[\dA-Z]{1,4}\b"
DATE = (
    r"(?U)(?:\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b"
    r"|\b\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}\b"
    r"|\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+\d{4}\b)"
)
RECOGNISERS = [
    ("EMAIL", EMAIL, 0.95),
    ("PHONE", PHONE, 0.70),
    ("SSN", SSN, 0.80),
    ("CREDIT_CARD", CREDIT_CARD, 0.75),
    ("IP_ADDRESS", IP_ADDRESS, 0.85),
    ("IBAN", IBAN, 0.80),
    ("DATE", DATE, 0.60),
]
STRUCTURED = ["CREDIT_CARD", "IBAN", "SSN", "EMAIL", "PHONE", "IP_ADDRESS", "DATE"]

# Words that raise the score of a span of their type nearby.
CONTEXT_KEYWORDS = {
    "PERSON": [
        "name", "named", "called", "mr", "mrs", "ms", "dr", "prof", "author", "patient", "client", "employee", "contact", "person", "user",
        "owner", "recipient", "sender",
    ],
    "EMAIL": ["email", "e-mail", "mail", "contact", "send", "write", "reach", "address"],
    "PHONE": ["phone", "call", "tel", "telephone", "mobile", "cell", "fax", "number", "dial", "reach"],
    "LOCATION": ["address", "street", "city", "state", "country", "zip", "postal", "live", "lives", "located", "from", "born", "based"],
    "ADDRESS": ["address", "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "zip", "postal"],
    "URL": ["url", "link", "website", "web", "site", "homepage", "profile"],
    "USERNAME": ["username", "user", "handle", "login", "account", "profile"],
    "PASSWORD": ["password", "passcode", "secret", "credential", "token"],
    "SSN": ["ssn", "social", "security", "tax", "identification", "id"],
    "CREDIT_CARD": ["card", "credit", "debit", "visa", "mastercard", "amex", "payment", "cc"],
    "IBAN": ["iban", "bank", "account", "transfer", "wire", "routing"],
    "BANK_ACCOUNT": ["bank", "account", "routing", "transfer", "wire", "swift", "bic"],
    "DATE": ["born", "birthday", "dob", "date", "birth", "issued", "expires", "expiry"],
}
TOKEN = r"[\p{IsAlphabetic}\p{N}'\-]"

# Lowest score of a named-entity span after merging.
NER_MINIMUM = {
    "PERSON": 0.55, "EMAIL": 0.80, "PHONE": 0.80, "CREDIT_CARD": 0.80, "SSN": 0.80, "IBAN": 0.80, "IP_ADDRESS": 0.80, "LOCATION": 0.55,
    "ORGANIZATION": 0.50, "ADDRESS": 0.55, "URL": 0.60, "USERNAME": 0.60, "PASSWORD": 0.60, "BANK_ACCOUNT": 0.50, "DATE": 0.80, "MISC": 0.70,
}
# A model's own gate before that: the same, but for MISC.
NER_GATE_MISC = {"ai4privacy": 0.90, "bardsai": 0.70, "hikmaai": 0.90}

# Category thresholds: type -> (baseline, delta).
CATEGORY_THRESHOLDS = {
    "PASSWORD": (0.70, 0.05), "CREDIT_CARD": (0.50, 0.15), "SSN": (0.50, 0.15), "IBAN": (0.50, 0.15), "BANK_ACCOUNT": (0.50, 0.15),
    "EMAIL": (0.40, 0.20), "PHONE": (0.40, 0.20), "ADDRESS": (0.50, 0.20), "PERSON": (0.50, 0.20), "USERNAME": (0.50, 0.20),
    "IP_ADDRESS": (0.50, 0.20), "LOCATION": (0.50, 0.20), "ORGANIZATION": (0.50, 0.20), "URL": (0.50, 0.30), "DATE": (0.40, 0.30), "MISC": (0.50, 0.20),
}
GROUPS = {
    "Identity": ["PERSON", "USERNAME"], "Contact": ["EMAIL", "PHONE", "ADDRESS"], "Financial": ["CREDIT_CARD", "IBAN", "BANK_ACCOUNT", "SSN"], "Network": ["IP_ADDRESS"],
    "Location": ["LOCATION"], "Password": ["PASSWORD"], "Organization": ["ORGANIZATION"], "Low-signal": ["URL", "DATE", "MISC"],
}
GROUPS_OFF = ["Low-signal"]

# Dictionary of the built-in named-entity provider.
DICTIONARY = [
    ("Ada Lovelace", "PERSON", 0.92), ("David Smith", "PERSON", 0.92), ("Anna Müller", "PERSON", 0.92), ("Acme Corp", "ORGANIZATION", 0.90),
    ("Beispiel GmbH", "ORGANIZATION", 0.90), ("Berlin", "LOCATION", 0.88), ("München", "LOCATION", 0.88), ("42 Cedar St", "ADDRESS", 0.91),
    ("https://portal.example/private", "URL", 0.94), ("alice_admin", "USERNAME", 0.89), ("correct-horse", "PASSWORD", 0.87), ("1234567890", "BANK_ACCOUNT", 0.86),
]

# Label taxonomies of the models: type -> labels.
NER_LABELS = {
    "ai4privacy": {
        "PERSON": [
            "PER", "PERSON", "NAME", "FULL_NAME", "FIRSTNAME", "FIRST_NAME", "GIVEN_NAME", "LASTNAME", "LAST_NAME", "FAMILY_NAME",
            "MIDDLENAME", "MIDDLE_NAME",
        ],
        "ORGANIZATION": ["ORG", "ORGANIZATION", "ORGANISATION", "COMPANY", "COMPANY_NAME", "COMPANYNAME", "BUSINESS"],
        "LOCATION": ["LOC", "LOCATION", "GPE", "CITY", "COUNTRY", "STATE", "COUNTY", "REGION"],
        "ADDRESS": [
            "ADDRESS", "STREET", "STREET_ADDRESS", "STREETADDRESS", "POSTAL_ADDRESS", "POSTCODE", "POSTAL_CODE", "ZIP", "ZIPCODE",
            "ZIP_CODE",
        ],
        "URL": ["URL", "URI", "WEBSITE", "WEB_URL"],
        "USERNAME": ["USERNAME", "USER_NAME", "HANDLE", "LOGIN"],
        "PASSWORD": ["PASSWORD", "PASSWD", "PASSCODE", "PIN"],
        "BANK_ACCOUNT": ["BANK_ACCOUNT", "BANKACCOUNT", "ACCOUNT_NUMBER", "ACCOUNTNUMBER", "BANK_ACCOUNT_NUMBER"],
        "EMAIL": ["EMAIL", "EMAIL_ADDRESS", "MAIL"],
        "PHONE": ["PHONE", "PHONE_NUMBER", "PHONENUMBER", "TELEPHONE", "MOBILE"],
        "CREDIT_CARD": ["CREDIT_CARD", "CREDITCARD", "CREDIT_CARD_NUMBER", "CREDITCARDNUMBER"],
        "SSN": ["SSN", "SOCIAL_SECURITY_NUMBER", "SOCIALSECURITYNUMBER"],
        "IBAN": ["IBAN", "IBAN_CODE"],
        "IP_ADDRESS": ["IP", "IP_ADDRESS", "IPV4", "IPV6"],
        "DATE": ["DATE", "DOB", "DATE_OF_BIRTH", "BIRTHDATE"],
        "MISC": ["MISC", "PASSPORT", "PASSPORT_NUMBER", "DRIVER_LICENSE", "DRIVERS_LICENSE", "NATIONAL_ID", "ID_CARD"],
    },
    "bardsai": {
        "USERNAME": ["ACCOUNT_IDENTIFIER", "CONTACT_HANDLE"],
        "PASSWORD": ["AUTH_SECRET"],
        "BANK_ACCOUNT": ["BANK_ACCOUNT_IDENTIFIER"],
        "DATE": ["DATE_OF_BIRTH"],
        "EMAIL": ["EMAIL_ADDRESS"],
        "LOCATION": ["GEO_LOCATION", "LOCATION"],
        "URL": ["IDENTIFYING_LINK"],
        "IP_ADDRESS": ["IP_ADDRESS"],
        "ORGANIZATION": ["ORGANIZATION_IDENTIFIER", "ORGANIZATION_NAME"],
        "CREDIT_CARD": ["PAYMENT_CARD", "PAYMENT_CARD_SECURITY"],
        "PERSON": ["PERSON_ALIAS", "PERSON_NAME"],
        "PHONE": ["PHONE_NUMBER"],
        "ADDRESS": ["POSTAL_ADDRESS"],
        "MISC": [
            "BIOMETRIC_DATA", "CRIMINAL_OFFENCE_DATA", "DEVICE_IDENTIFIER", "DOCUMENT_IDENTIFIER", "DOCUMENT_REFERENCE", "ETHNIC_ORIGIN",
            "FINANCIAL_AMOUNT", "HEALTH_DATA", "PERSON_ATTRIBUTE", "PERSON_IDENTIFIER", "PERSON_ROLE_OR_TITLE", "POLITICAL_OPINION",
            "PROPER_NAME", "RELIGION_OR_BELIEF", "SEXUAL_ORIENTATION", "TRADE_UNION_MEMBERSHIP", "VEHICLE_IDENTIFIER",
        ],
    },
    "hikmaai": {
        "PERSON": ["GIVENNAME", "SURNAME"],
        "DATE": ["DATEOFBIRTH"],
        "USERNAME": ["USERNAME"],
        "PASSWORD": ["PASSWORD"],
        "EMAIL": ["EMAIL"],
        "PHONE": ["TELEPHONENUM"],
        "ADDRESS": ["STREET", "BUILDINGNUM", "ZIPCODE"],
        "LOCATION": ["CITY"],
        "CREDIT_CARD": ["CREDITCARDNUMBER"],
        "BANK_ACCOUNT": ["ACCOUNTNUM"],
        "SSN": ["SOCIALNUM"],
        "MISC": ["TAXNUM", "DRIVERLICENSENUM", "IDCARDNUM"],
    },
}
# Labels of raw corpus records beside the types' own names: type -> labels.
CORPUS_LABELS = {
    "USERNAME": ["ACCOUNT_NAME"],
    "MISC": [
        "AGE", "DRIVER_LICENSE", "DRIVER_LICENSE_NUMBER", "GENDER", "ID_CARD", "ID_CARD_NUMBER", "PASSPORT", "PASSPORT_NUMBER", "PIN",
        "POSTAL_CODE", "TAX_ID", "TAX_IDENTIFICATION_NUMBER", "ZIP_CODE",
    ],
    "DATE": ["BIRTH_DATE", "DATE_OF_BIRTH", "DOB"],
    "ADDRESS": ["BUILDING_NUMBER", "STREET", "STREET_ADDRESS"],
    "LOCATION": ["CITY", "COUNTRY", "STATE"],
    "CREDIT_CARD": ["CREDIT_CARD_NUMBER", "CREDITCARDNUMBER"],
    "EMAIL": ["EMAIL_ADDRESS"],
    "PERSON": ["FIRST_NAME", "FIRSTNAME", "FULL_NAME", "GIVEN_NAME", "LAST_NAME", "LASTNAME", "NAME"],
    "PHONE": ["PHONE_NUMBER"],
    "SSN": ["SOCIALNUMBER", "SOCIAL_SECURITY_NUMBER"],
}
# Types that the coverage sampler balances, in order.
SAMPLED_TYPES = ["ADDRESS", "CREDIT_CARD", "DATE", "EMAIL", "LOCATION", "PERSON", "PHONE", "SSN"]

# Synthetic values by type, in order of use.
POOLS = {
    "PERSON": [
        "Jordan Park", "Casey Morrow", "Avery Quinn", "Riley Bennett", "Morgan Sato", "Sage Carrillo", "Quinn Holloway", "Reese Aldana",
        "Hayden Pereira", "Devon Tatsumi", "Emery Coleman", "Skyler Bishop", "Rowan Esposito", "Cameron Liu", "Drew Whitfield", "Logan Marquez",
        "Phoenix Andrade", "Tatum Okafor", "Noor Aldridge", "Aspen Fontaine", "Indigo Ramos", "Wren Sutherland", "Ellis Vargas", "Frankie Bowen",
    ],
    "LOCATION": [
        "Springwood", "Bridgewater", "Northvale", "Cedar Hollow", "Westmoor", "Stonebrook", "Fairhaven", "Riverbend",
        "Hillcrest", "Oakridge", "Pinewell", "Brookline Park", "Lakeshore", "Foxglen", "Maple Heights", "Silverpoint",
    ],
    "ORGANIZATION": [
        "Quantum Ridge Industries", "Atlas Group", "Midwest Holdings", "Northstar Solutions", "Cobalt Logistics", "Vertex Manufacturing",
        "Greenline Partners", "Harborwave Capital", "Ironcrest Software", "Silverthorn Media", "Pinepoint Research", "Brightwater Systems",
        "Cedarpath Consulting", "Lumiscope Labs", "Foxhaven Enterprises", "Riftgate Holdings",
    ],
    "ADDRESS": [
        "742 Evergreen Ln", "1521 Maple Ave", "38 Foxglove Rd", "904 Cedar Hollow Dr", "227 Westmoor Ct", "610 Hawthorn St",
        "1843 Brookline Way", "76 Pineapple Ridge", "350 Aurora Pkwy", "1109 Linden Cir", "85 Birchcrest Ter", "6204 Silverpoint Ave",
    ],
    "USERNAME": ["parkour_jordan", "casey_dev", "avery_2025", "riley_writes", "morgan_codes", "sage_says", "quinn_q", "reese_reader", "hayden_makes", "devon_dev"],
    "MISC": ["Project Bluebird", "Initiative Echo", "Item Falcon", "Reference Spruce", "Codename Lantern", "Token Mariner"],
    "PHONE": ["+1 (555) 010-0123", "+1 (555) 010-0145", "+1 (555) 010-0167", "+1 (555) 010-0189", "+1 (555) 010-0211", "+1 (555) 010-0233"],
    "CREDIT_CARD": ["4111 1111 1111 1111", "5555 5555 5555 4444", "3782 822463 10005", "6011 1111 1111 1117"],
    "SSN": ["900-92-0001", "900-92-0042", "900-92-0117", "900-92-0234", "900-92-0367"],
    "IBAN": ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606"],
    "IP_ADDRESS": ["192.0.2.10", "192.0.2.42", "198.51.100.7", "198.51.100.55", "203.0.113.21", "203.0.113.99"],
    "BANK_ACCOUNT": ["9999 0001 2345 6701", "9999 0001 9876 5432", "9999 0002 1357 9024"],
}
EMAIL_DOMAINS = ["example.com", "example.org", "example.net"]

# Fixed value: what the class and attribute names of rendered marks begin with.
MARK_PREFIX = "pg"

# Models that can be chosen, their precisions, and after how many milliseconds an idle one is unloaded.
ACTIVE_MODELS, MODEL_DTYPES = ["bardsai"], ["q4f16"]
UNLOAD_TIMEOUTS_MS, UNLOAD_TIMEOUT_MS = [60_000, 300_000, 600_000, 1_800_000, None], 600_000

# What a page says of a host, by rule: tone, title, detail.
RESOURCE_SUMMARIES = {
    "failed": ("critical", "Local AI failed to load", "Pattern detection remains active. Retry from Local AI settings."),
    "protected": ("critical", "Low memory protection mode", "Local AI is off because browser-reported memory is {memory} (critical). Pattern detection remains active."),
    "overridden": ("critical", "Local AI enabled despite low memory", "Browser-reported memory is {memory} (critical). Local AI may slow or freeze this browser."),
    "off": ("info", "Local AI detection off", "Pattern detection remains active. Names, organizations, locations, and context-only PII may be missed."),
    "on_cpu": ("warning", "Local AI is running on CPU", "WebGPU was not used. Detection may be slower than usual."),
    "tight": ("warning", "Local AI may be resource-intensive", "Browser-reported memory is {memory} (between 2 GB and 4 GB). Watch for slowdowns while Local AI is on."),
    "uncertain": ("warning", "Compatibility uncertain", "Browser-reported memory is unavailable, so Local AI compatibility could not be fully assessed."),
}
