"""Results must agree on them to be right."""

# English function words.
STOP_EN = (
    "a an the this that these those is am are was were be been being do does did doing done have has had having "
    "can could will would shall should may might must i me my mine myself you your yours we us our ours "
    "he him his she her hers it its they them their theirs of in on at to for from by with about "
    "as into onto over under up down out off and or but if then than so because "
    "there here not no any some all each very what which who whom whose when where why how "
    "tell give show please kindly"
).split()
# Devanagari function words, Hindi then Marathi.
STOP_HI = (
    "का के की को में से पर है हैं था थे थी और या यह वह ये वे एक कि जो तो ही भी "
    "हूँ हूं हो होता होती होते किया करना करें कर क्या कौन कब कहाँ कहां क्यों कैसे कितना कितनी किस "
    "मेरा मेरी मेरे आपका आपकी तुम आप मैं हम उनका बताओ बताएं बताइए "
    "चा ची चे मध्ये आहे आहेत आणि काय कोण कुठे कसे किती सांगा"
).split()
# Romanised Hindi closed-class words and their Devanagari forms.
ROMANISED = {
    "kya": "क्या", "kyaa": "क्या", "kia": "क्या", "kaun": "कौन", "kon": "कौन", "kaunsa": "कौन सा", "konsa": "कौन सा",
    "kab": "कब", "kahan": "कहाँ", "kaha": "कहाँ", "kahaan": "कहाँ", "kyon": "क्यों", "kyu": "क्यों", "kyun": "क्यों", "kyo": "क्यों",
    "kaise": "कैसे", "kaisa": "कैसा", "kaisi": "कैसी", "kese": "कैसे", "kitna": "कितना", "kitne": "कितने", "kitni": "कितनी",
    "kis": "किस", "kaunse": "कौन से", "matlab": "मतलब", "arth": "अर्थ", "paribhasha": "परिभाषा",
    "hai": "है", "hain": "हैं", "h": "है", "hota": "होता", "hoti": "होती", "hote": "होते", "tha": "था", "the": "थे", "thi": "थी",
    "hoga": "होगा", "hogi": "होगी", "karta": "करता", "karti": "करती", "karte": "करते", "kare": "करे",
    "ka": "का", "ke": "के", "ki": "की", "ko": "को", "se": "से", "me": "में", "mein": "में", "par": "पर", "tak": "तक", "liye": "लिए",
    "aur": "और", "ya": "या", "lekin": "लेकिन", "agar": "अगर", "to": "तो", "bare": "बारे", "baare": "बारे",
    "yeh": "यह", "ye": "ये", "woh": "वह", "vah": "वह", "wo": "वो", "ek": "एक", "sab": "सब", "kuch": "कुछ", "koi": "कोई", "sabhi": "सभी",
    "nahi": "नहीं", "nahin": "नहीं", "haan": "हाँ", "bhi": "भी", "naam": "नाम", "log": "लोग", "cheez": "चीज़",
}
# Words of a request that are dropped.
SCAFFOLD = (
    "mujhe muje mera meri mere hume humein batao bataiye bataye bata batana batayen "
    "samjhao samjhaiye samjha likho likhiye kripya kripaya please plz zara jara bhai yaar sir madam"
).split()
# Romanised words that are English words too: they don't count as markers.
AMBIGUOUS = "he me the to so par ki se ye wo h bare log sab ka tak kis arth hai".split()
# Scripts by character range; the earlier wins a tie.
SCRIPTS = (
    ("latin", "A-Za-z"), ("deva", "ऀ-ॿ"), ("beng", "ঀ-৿"), ("guru", "਀-੿"), ("gujr", "઀-૿"),
    ("orya", "଀-୿"), ("taml", "஀-௿"), ("telu", "ఀ-౿"), ("knda", "ಀ-೿"), ("mlym", "ഀ-ൿ"), ("arab", "؀-ۿ"),
)
# The zero of each numeral system that is read as ASCII digits.
DIGIT_ZEROS = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0660, 0x06F0)
# Spans and runs.
NUMERIC = r"\d[\d,.\-/%]*"
LATIN_RUN = r"[A-Za-z][A-Za-z.\-]{2,}"
# Input gate patterns, in the order they are tried.
SELF_HARM = r"(?i)\b(kill\s+myself|commit\s+suicide|end\s+my\s+life|want\s+to\s+die)\b|आत्महत्या"
UNSAFE = (
    r"(?i)\bhow\s+(to|do\s+i|can\s+i)\s+(make|build|synthesi[sz]e|obtain)\s+.{0,30}\b(bomb|explosive|nerve\s+agent|ricin|meth(amphetamine)?|napalm)\b",
    r"(?i)\bhow\s+(to|do\s+i|can\s+i)\s+.{0,25}\b(kill|murder|poison)\s+(a\s+)?(person|someone|him|her|them|my)\b",
    r"(?i)\b(kill|hang|cut)\s+(myself|my\s?self)\b|\bcommit\s+suicide\b|\bend\s+my\s+life\b",
    r"(?i)\bchild\s+(porn|sexual|abuse\s+material)\b|\bCSAM\b",
    r"(?i)\bhow\s+to\s+(hack|breach|ddos)\s+.{0,20}\b(bank|hospital|government|grid)\b",
    r"आत्महत्या\s*(कैसे|करने)",
    r"(बम|विस्फोटक)\s*(कैसे\s*)?(बनाएं|बनाना|बनाऊं)",
)
INJECTION = (
    r"(?i)\bignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)\b",
    r"(?i)\bdisregard\s+(all\s+|the\s+)?(previous|prior|above|instructions?)\b",
    r"(?i)\b(system|developer)\s+(prompt|message|instruction)",
    r"(?i)\byou\s+are\s+now\b|\bfrom\s+now\s+on\s+you\b|\bact\s+as\s+(a|an|if)\b",
    r"(?i)\b(reveal|show|print|repeat|output)\s+(me\s+)?(your|the)\s+(prompt|instructions?|rules?)\b",
    r"(?i)\bdeveloper\s+mode\b|\bjailbreak\b|\bDAN\s+mode\b",
    r"पिछले?\s+निर्देश|पहले\s+के\s+निर्देश",
    r"निर्देश\s*(को)?\s*(अनदेखा|नज़रअंदाज़|भूल)",
    r"तुम\s+अब\s+से|आप\s+अब\s+से",
    r"अपने\s+(निर्देश|नियम)\s*(दिखाओ|बताओ)",
)
IMPERATIVE = (
    r"(?i)^\s*(please\s+|kindly\s+|now\s+|just\s+)*(go\s+ahead\s+and\s+|make\s+sure\s+(you|to)\s+)?"
    r"(delete|remove|drop|erase|wipe|destroy|purge|truncate|shut\s*down|reboot|restart|execute|run|install|uninstall|deploy|send|email|post|publish|tweet|"
    r"transfer|wire|pay|buy|order|disable|enable|grant|revoke|overwrite|format|kill|terminate)\b"
)
QUESTION = r"(?i)\?|^(what|who|when|where|why|how|which|is|are|was|were|does|do|did|can|could|should|will|would|list|name|define|tell)\b"
# Question words by script; the first script a text has decides.
QUESTION_BY_SCRIPT = (
    ("ऀ-ॿ", r"क्या|काय|कौन|कोण|कब|कधी|केव्हा|कहाँ|कहां|कुठे|क्यों|का\b|कैसे|कसे|कितन|किती|किस|कोणत|बताओ|बताएं|सांगा|नाम|कस्तो|कहिले|कहाँबाट"),
    ("ঀ-৿", r"কি|কী|কে|কোন|কখন|কেতিয়া|কোথায়|ক'ত|কেন|কিয়|কীভাবে|কিভাবে|কেনেকৈ|কত|কার"),
    ("਀-੿", r"ਕੀ|ਕੌਣ|ਕਦੋਂ|ਕਿੱਥੇ|ਕਿਥੇ|ਕਿਉਂ|ਕਿਵੇਂ|ਕਿਹੜ|ਕਿੰਨ|ਦੱਸੋ"),
    ("઀-૿", r"શું|કોણ|ક્યારે|ક્યાં|કેમ|શા\s*માટે|કેવી\s*રીતે|કયો|કઈ|કેટલ|જણાવો"),
    ("଀-୿", r"କ'?ଣ|କିଏ|କେବେ|କେଉଁ|କାହିଁକି|କିପରି|କେତେ|କହନ୍ତୁ"),
    ("஀-௿", r"என்ன|யார்|எப்போது|எங்கே|எங்கு|ஏன்|எப்படி|எந்த|எத்தனை|எவ்வளவு|கூறு"),
    ("ఀ-౿", r"ఏమిటి|ఏమి|ఎవరు|ఎప్పుడు|ఎక్కడ|ఎందుకు|ఎలా|ఏది|ఏ\s|ఎంత|చెప్ప"),
    ("ಀ-೿", r"ಏನು|ಯಾರು|ಯಾವಾಗ|ಎಲ್ಲಿ|ಏಕೆ|ಹೇಗೆ|ಯಾವ|ಎಷ್ಟು|ಹೇಳಿ"),
    ("ഀ-ൿ", r"എന്ത|ആര|എപ്പോൾ|എവിടെ|എന്തുകൊണ്ട|എങ്ങനെ|ഏത|എത്ര|പറയ"),
    ("؀-ۿ", r"کیا|کون|کب|کہاں|کیوں|کیسے|کونسا|کتنا|بتائیں|بتاؤ"),
)
# Fusion weights of the strategies; any other weighs 1. The rank constant.
WEIGHTS = {"whole": 1.0, "contextual": 1.0, "sentence": 0.9, "lexical": 0.8, "semantic": 0.7, "sliding": 0.6, "document": 0.5}
RANK_CONSTANT = 60
# BM25.
K1, B, DF_CEILING, TF_MOST = 1.2, 0.75, 0.15, 255
# Languages by the script that is read out; the earlier wins a tie.
SPOKEN = (
    ("bn", "ঀ-৿"), ("gu", "઀-૿"), ("pa", "਀-੿"), ("or", "଀-୿"), ("ta", "஀-௿"),
    ("te", "ఀ-౿"), ("kn", "ಀ-೿"), ("ml", "ഀ-ൿ"), ("ur", "؀-ۿ"), ("hi", "ऀ-ॿ"),
)
