"""Word lists, lookup tables, constants and patterns.

Everything in this module is a fixed value that results depend on.  Nothing here
is logic; the operators turn these tables into Spark expressions.
"""

# ---------------------------------------------------------------- severities
# fixed values: legal severities and the weights attached to them
SEVERITIES = ["Fatal", "Grievous", "Non-Fatal", "Unknown"]
DANGER_WEIGHT = {"Fatal": 3.0, "Grievous": 2.0, "Non-Fatal": 1.0, "Unknown": 0.5}
HEAT_WEIGHT = {"Fatal": 1.0, "Grievous": 0.7, "Non-Fatal": 0.4, "Unknown": 0.3}
SEVERITY_LABEL = {"Fatal": 2, "Grievous": 1, "Non-Fatal": 0, "Unknown": 0}
LABEL_SEVERITY = {2: "Fatal", 1: "Grievous", 0: "Non-Fatal"}
SORT_RANK = {"Fatal": 0, "Grievous": 1, "Simple": 2, "Non-Injury": 3, "Unknown": 4}

# fixed values: placeholders
CAUSE_PLACEHOLDER = "Under Investigation"
OTHER_STATIONS = "OTHER STATIONS"
OTHER_AREAS = "OTHER AREAS"
UNKNOWN_AREA = "Unknown Area"

# fixed values: age bands (label, low, high) and four-hour slots (label, from, to)
AGE_BANDS = [("0-17", 0, 17), ("18-25", 18, 25), ("26-35", 26, 35), ("36-50", 36, 50)]
TIME_SLOTS = [
    ("Late Night (00-04)", 0, 3),
    ("Early Morning (04-08)", 4, 7),
    ("Morning Peak (08-12)", 8, 11),
    ("Afternoon (12-16)", 12, 15),
    ("Evening Peak (16-20)", 16, 19),
    ("Night (20-00)", 20, 23),
]

# fixed values: words that disqualify a label from being reported as "top"
CAUSE_BLACKLIST = [
    "negligent", "rash", "driving", "unknown", "other", "accident",
    "action taken", "investigation", "registered", "offence", "commission",
    "delay", "reporting", "complainant", "informant",
]
LOCATION_BLACKLIST = ["p.s.", "police", "station", "ntr", "district", "unknown", "road", "near"]
UNKNOWN_BLACKLIST = ["unknown"]

# ---------------------------------------------------------------- extraction
# fixed values: patterns of the report text extraction
REPORT_NUMBER_PATTERNS = [
    r"(?i)FIR\s*No\.?\s*[:\-]?\s*([A-Z0-9/\-]+)",
    r"(?i)Crime\s*No\.?\s*[:\-]?\s*([A-Z0-9/\-]+)",
]
DATE_TOKEN_PATTERNS = [
    r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?)",
    r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
]
PLACE_PATTERN = r"(?i)(?:Location|Place|Address|Near|At)\s*[:\-]?\s*(.+?)(?:\n|$)"
FATAL_WORDS = ["death", "dead", "fatal", "killed", "died", "expire", "deceased"]
GRIEVOUS_WORDS = ["grievous", "serious", "critical", "severe", "fracture"]
CAUSE_PATTERNS = [
    r"(?i)(?:cause|reason)\s*[:\-]?\s*(.+?)(?:\n|\.)",
    r"(?i)(over\s*speed(?:ing)?|rash\s*driv(?:ing)?|drunk\s*driv(?:ing)?|negligent)",
]
AGE_PATTERN = r"(?i)Age\s*[:\-]?\s*(\d{1,3})"
GENDER_PATTERN = r"(?i)Gender\s*[:\-]?\s*(Male|Female)"
PLATE_PATTERN = (
    r"(?i)(?:Vehicle\s*No\.?\s*[:\-]?\s*|Registration\s*No\.?\s*[:\-]?\s*|Reg\.?\s*No\.?\s*[:\-]?\s*)"
    r"([A-Z]{2}\s?\d{1,2}\s?[A-Z]{0,3}\s?\d{1,4})"
)
REPORT_DATE_PATTERN = r"(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})(?:\s+(\d{1,2}):?(\d{2})?)?"

# fixed values: phrases of the printed form that are not data
FORM_PHRASES = [
    "reasons for delay in reporting", "delay in reporting", "complainant", "informant",
    "first information report", "ion report", "p.s.", "police station", "under section",
    "acts & sections", "occurrence of offence", "information received at p.s.",
    "station house officer", "sho", "dated", "time", "landmark",
]
FORM_GUARD_PATTERN = (
    r"(?i)reasons\s+for\s+delay|delay\s+in\s+reporting|police\s+station|ion\s+report|p\.s\."
)
FORM_HEADERS = [
    "reasons for delay in reporting", "s for delay in reporting", "informant",
    "delay in reporting", "complainant", "ion report", "first information report",
    "p.s.", "police station", "date and time", "landmark",
]
FORM_LABELS = [
    "first information report", "district", "ps:", "p.s.", "year", "date", "time", "acts", "sections",
]

# fixed values: station header patterns
STATION_PATTERNS = [
    r"(?i)\bP\.?\s*S\.?\s*[:\-]?\s*([^\n]{2,120})",
    r"(?i)(?:^|\n)\s*Police\s*Station\s*[:\-]?\s*([^\n]{2,120})",
]
STATION_LINE = r"(?i)P\.?\s*S\.?"
STATION_LINE_SKIP = [
    r"(?i)information\s+received\s+at\s+p\.?\s*s\.?",
    r"(?i)name\s+of\s+p\.?\s*s\.?",
]
STATION_LINE_PREFIX = r"(?i)^.*?P\.?\s*S\.?\s*[:\-]?\s*"
STATION_TAIL = r"(?i)\b(?:Year|FIR\s*No\.?|Date|Acts?|Section(?:s)?|District)\b.*$"
STATION_EDGES = r"^[\s:.\-]+|[\s:.\-]+$"

# ---------------------------------------------------------------- causes
# fixed values: keyword -> crime type, in priority order
CRIME_TYPES = [
    ("drunk", "Drunk Driving"),
    ("rash", "Rash Driving"),
    ("over speed", "Over Speeding"),
    ("overspe", "Over Speeding"),
    ("signal", "Signal Violation"),
    ("wrong side", "Wrong Side Driving"),
    ("negligent", "Negligent Driving"),
    ("hit and run", "Hit and Run"),
    ("hit & run", "Hit and Run"),
]
# fixed values: keyword -> numeric cause code, in priority order
CAUSE_CODES = [
    ("over speed", 1), ("overspe", 1), ("rash", 2), ("drunk", 3), ("signal", 4),
    ("wrong side", 5), ("negligent", 6), ("hit and run", 7), ("hit & run", 7),
]
# fixed values: accepted date layouts of the temporal features
FEATURE_DATE_LAYOUTS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
]

# ---------------------------------------------------------------- stations
# fixed values: the reporting stations, in report order
STATIONS = [
    "Governorpet - CRIME", "Krishnalanka - CRIME", "Machavaram - CRIME", "Patamata - CRIME",
    "Satyanarayanapuram - CRIME", "Suryaraopet - CRIME", "Vijayawada I Town - CRIME",
    "Vijayawada II Town - CRIME", "CCS, Vijayawada", "Cyber Crime", "Mahila UPS, Vijayawada",
    "Gunadala", "Machavaram", "Patamata", "Governorpet", "Krishnalanka", "Suryaraopet",
    "Ajith Singh Nagar", "Nunna", "Satyanarayanapuram", "Bhavanipuram", "Ibrahimpatnam",
    "Vijayawada I Town", "Vijayawada II Town", "Vijayawada Traffic I (T)",
    "Vijayawada Traffic II (T)", "Vijayawada Traffic III (T)", "Vijayawada Traffic IV (T)",
    "Vijayawada Traffic V (T)", "G. Konduru", "Mylavaram", "Reddigudem", "A. Konduru",
    "Gampalagudem", "Tiruvuru", "Vissannapet", "Nandigama", "Chillakallu", "Jaggaiahpet",
    "Penuganchiprolu", "Vatsavai", "Chandarlapadu", "Kanchikacherla", "Veerulapadu",
]

# fixed values: (pattern on the normalised station name, station), first match wins
STATION_RULES = [
    (r"CYBER", "Cyber Crime"),
    (r"CCS", "CCS, Vijayawada"),
    (r"MAHILA", "Mahila UPS, Vijayawada"),
    (r"\bTRAFFIC\s*I\b|\bTRAFIC\s*I\b", "Vijayawada Traffic I (T)"),
    (r"\bTRAFFIC\s*II\b", "Vijayawada Traffic II (T)"),
    (r"\bTRAFFIC\s*III\b", "Vijayawada Traffic III (T)"),
    (r"\bTRAFFIC\s*IV\b", "Vijayawada Traffic IV (T)"),
    (r"\bTRAFFIC\s*V\b", "Vijayawada Traffic V (T)"),
    (r"\bG\s*KONDURU\b|\bGONDURU\b", "G. Konduru"),
    (r"\bA\s*KONDURU\b", "A. Konduru"),
    (r"GAMPALAGUDEM", "Gampalagudem"),
    (r"TIRUVURU", "Tiruvuru"),
    (r"VISSANNAPET", "Vissannapet"),
    (r"MYLAVARAM", "Mylavaram"),
    (r"REDDIGUDEM", "Reddigudem"),
    (r"NANDIGAMA", "Nandigama"),
    (r"CHILLAKALLU", "Chillakallu"),
    (r"JAGGAIAHPET", "Jaggaiahpet"),
    (r"PENUGANCHIPROLU", "Penuganchiprolu"),
    (r"VATSAVAI|VATSVAI", "Vatsavai"),
    (r"CHANDARLAPADU", "Chandarlapadu"),
    (r"KANCHIKACHERLA", "Kanchikacherla"),
    (r"VEERULAPADU", "Veerulapadu"),
    (r"KRISHNALANKA|KRISHNA LANKA", "Krishnalanka - CRIME"),
    (r"GOVERNORPET", "Governorpet - CRIME"),
    (r"MACHAVARAM", "Machavaram - CRIME"),
    (r"PATAMATA", "Patamata - CRIME"),
    (r"SATYANARAYANAPURAM", "Satyanarayanapuram - CRIME"),
    (r"SURYARAOPET", "Suryaraopet - CRIME"),
    (r"\bI\s*TOWN\b|\b1\s*TOWN\b", "Vijayawada I Town - CRIME"),
    (r"\bII\s*TOWN\b|\b2\s*TOWN\b", "Vijayawada II Town - CRIME"),
    (r"VIJAYAWADA TOWN", "Vijayawada I Town - CRIME"),
    (r"GUNADALA", "Gunadala"),
    (r"AJITH|SINGH NAGAR|AS NAGAR", "Ajith Singh Nagar"),
    (r"NUNNA", "Nunna"),
    (r"BHAVANIPURAM", "Bhavanipuram"),
    (r"IBRAHIMPATNAM", "Ibrahimpatnam"),
]

# ---------------------------------------------------------------- hierarchy
# fixed values: group -> zone -> station names
STATION_TREE = {
    "DCP CRIMES": {
        "Vijayawada CCS Circle": [
            "Governorpet (Crime)", "Krishnalanka (Crime)", "Machavaram (Crime)", "Patamata (Crime)",
            "Satyanarayanapuram (Crime)", "Suryaraopet (Crime)", "Vijayawada I Town (Crime)",
            "Vijayawada II Town (Crime)",
        ],
        "Other Crime Units": ["CCS, Vijayawada", "Cyber Crime"],
    },
    "DCP LAW & ORDER - 1": {
        "Vijayawada Central Zone": ["Gunadala", "Machavaram", "Patamata"],
        "Vijayawada South Zone": [
            "Governorpet", "Krishnalanka", "Suryaraopet", "Krishna Lanka", "KrishnaLanka",
        ],
        "Mahila UPS": ["Mahila UPS, Vijayawada"],
        "Vijayawada Generic Area (Unknown Zone)": [
            "Vijayawada", "Vijayawada East", "Vijayawada City", "Vijayawada city",
            "Labbipet, Vijayawada", "NTR Commissionerate", "Madhura Nagar",
        ],
    },
    "DCP LAW & ORDER - 2": {
        "Vijayawada North Zone": [
            "Ajith Singh Nagar", "Nunna", "Satyanarayanapuram", "Ajithsingh Nagar", "AS Nagar",
            "Singh Nagar", "Prasadampadu", "Enikepadu", "Nidamanuru", "Ramavarappadu",
            "Payakapuram", "Prakash Nagar, Payakapuram", "Kandrika, Payakapuram",
            "Nunna Village, Vijayawada Rural", "Nunna Village, Nuzivid Road, Vijayawada Rural",
            "Auto Nagar",
        ],
        "Vijayawada West Zone": [
            "Bhavanipuram", "Ibrahimpatnam", "Ibrahimpatnam Mandal", "Ibrahimpatnam mandal",
            "Ibrahimpatnam Village and Mandal", "West Ibrahimpatnam, Ibrahimpatnam",
            "Guntupalli Village, Ibrahimpatnam Mandal", "Vijayawada I Town", "Vijayawada II Town",
            "I Town", "Vidyadharapuram", "Kummaripalem", "Gollapudi, Vijayawada Rural",
            "Gollapudi", "Ambapuram panchayathi",
        ],
        "Vijayawada Rural (Generic/West)": [
            "Vijayawada Rural", "Vijayawada rural", "Vjayawada rural", "Vijayawada Rural Mandal",
            "Vijayawada rural Mandal",
        ],
    },
    "DCP TRAFFIC": {
        "Vijayawada Traffic Zone": [
            "Vijayawada Traffic I (T)", "Vijayawada Traffic II (T)", "Vijayawada Traffic III (T)",
            "Vijayawada Traffic IV (T)", "Vijayawada Traffic V (T)",
        ],
    },
    "MYLAVARAM SDPO": {
        "Mylavaram Circle": [
            "G. Konduru", "G Konduru Mandal", "G. Konduru Mandal", "Konduru Mandal",
            "Vellaturu Village, G. Konduru Mandal", "Mylavaram", "Mylavaram Village and Mandal",
            "Mylavaram Mandal", "MVARAM BEAT NO-1", "MVARAM BEAT NO-3", "Reddigudem",
            "Reddigudem Mandal", "Naguluru Village, Reddigudem Mandal",
        ],
        "Tiruvuru Circle": [
            "A. Konduru", "A Konduru", "A. Konduru Mandal", "A.Konduru Mandal", "A Konduru Mandal",
            "A Konduru mandal", "A Konduru village and A Konduru mandal",
            "Gopalapuram Village, A Konduru Mandal", "Gampalagudem", "Gampalagudem Mandal",
            "Gampalagudem Village and Mandal", "Gampalagduem Mandal",
            "Penugolanu Village, Gampalagudem Mandal", "Tiruvuru", "Vissannapet",
            "Vissannapeta Mandal", "Vissannapeta Town",
        ],
    },
    "NANDIGAMA SDPO": {
        "Nandigama": [
            "Nandigama", "Nandigama Mandal", "Nandigama mandal", "Nandigama town",
            "Nandigama town & Mandal", "Nandigama Town and Mandal",
        ],
        "Jaggaiahpet Circle": [
            "Chillakallu", "Jaggaiahpet", "Jaggaiahpet mandal", "Jaggaiahpet Mandal",
            "Jaggaihapeta Mandal", "Penuganchiprolu", "Penuganchiprolu Mandal",
            "Penuganchiprolu Village & Mandal", "Penuganchiprolu Village and Mandal",
            "Nawabpeta Village, Penuganchiprolu Mandal", "Lingagudem Village, Penuganchiprolu Mandal",
            "Vatsavai", "Vatsavai Mandal", "Vatsavai mandal", "Vatsvai mandal",
            "Vatsavai Village & Mandal",
        ],
        "Nandigama Rural Circle": [
            "Chandarlapadu", "Chandarlapadu Mandal", "Kanchikacherla", "Kanchikacherla Mandal",
            "Kanchikacherla Village and Mandal", "Kanchikacherla mandal",
            "Paritala village, Kanchikacherla", "Keesara Village, Kanchikacherla Mandal",
            "Vemulaplli Village, Kanchikacherla Mandal", "Veerulapadu", "Veerulapadu Mandal",
            "Kotha Repudi Village", "THotacharla", "Gudlavalleru Mandal",
        ],
    },
}
# fixed values: groups in the order in which they claim a record
GROUP_PRIORITY = [
    "DCP CRIMES", "DCP TRAFFIC", "MYLAVARAM SDPO", "NANDIGAMA SDPO",
    "DCP LAW & ORDER - 2", "DCP LAW & ORDER - 1",
]
# fixed values: names that only match a whole area
WHOLE_AREA_NAMES = ["vijayawada", "vijayawada city", "vijayawada rural", "ntr commissionerate"]
# fixed values: suffixes removed from a tree name before it is matched
STATION_SUFFIXES = [r"(?i) \(Crime\)$", r"(?i) \(T\)$", r"(?i), Vijayawada$"]

# ---------------------------------------------------------------- geography
# fixed values: bounding box (south, north, west, east) and map centre
DISTRICT_BOX = (16.25, 16.95, 80.00, 80.90)
MAP_CENTRE = (16.5062, 80.6200)
PLACEHOLDER_POINTS = [(16.5, 80.6), (16.5062, 80.648)]
PLACEHOLDER_TOLERANCE = 0.01

# fixed values: gazetteer name -> (latitude, longitude), in list order
GAZETTEER = [
    ("ayyappa nagar", 16.4877, 80.6707), ("yanamalakuduru", 16.4780, 80.6600),
    ("benz circle", 16.4996, 80.6634), ("governorpet", 16.5157, 80.6229),
    ("gandhi nagar", 16.5097, 80.6371), ("labbipet", 16.5088, 80.6412),
    ("moghalrajpuram", 16.5137, 80.6361), ("patamata", 16.4962, 80.6585),
    ("auto nagar", 16.4886, 80.6711), ("krishna lanka", 16.5224, 80.6107),
    ("machavaram", 16.5285, 80.6175), ("gunadala", 16.5253, 80.6357),
    ("suryaraopet", 16.5101, 80.6266), ("kothapet", 16.5077, 80.6440),
    ("ashok nagar", 16.5021, 80.6520), ("payakapuram", 16.5170, 80.6470),
    ("wynchipet", 16.5140, 80.6170), ("chuttugunta", 16.5080, 80.6370),
    ("ajit singh nagar", 16.4970, 80.6480), ("satyanarayanapuram", 16.5210, 80.6340),
    ("vidyadharapuram", 16.5050, 80.6540), ("ram nagar", 16.5030, 80.6550),
    ("one town", 16.5130, 80.6200), ("two town", 16.5090, 80.6300),
    ("three town", 16.5060, 80.6400), ("seethanagaram", 16.5200, 80.6050),
    ("prakasam barrage", 16.5140, 80.6120), ("mv road", 16.5100, 80.6350),
    ("mg road", 16.5120, 80.6320), ("ring road", 16.4900, 80.6500),
    ("penamaluru", 16.4700, 80.6750), ("kanuru", 16.4850, 80.7010),
    ("tadepalli", 16.4740, 80.6050), ("mangalagiri", 16.4310, 80.5680),
    ("nunna", 16.4420, 80.5990), ("poranki", 16.4890, 80.5760),
    ("gannavaram", 16.5430, 80.8040), ("ibrahimpatnam", 16.5780, 80.5160),
    ("mylavaram", 16.7490, 80.6560), ("kondapalli", 16.6180, 80.5330),
    ("chillakallu", 16.6200, 80.4500), ("vuyyuru", 16.3670, 80.8460),
    ("jaggayyapeta", 16.8920, 80.0980), ("jaggaiahpet", 16.8920, 80.0980),
    ("tiruvuru", 16.9060, 80.6120), ("nandigama", 16.7720, 80.2860),
    ("undavalli", 16.4940, 80.5780), ("eluru road", 16.5050, 80.5900),
    ("bandar road", 16.4980, 80.6900), ("nh16", 16.4950, 80.6600),
    ("nh65", 16.7000, 80.3000), ("nh-65", 16.7000, 80.3000), ("nh 65", 16.7000, 80.3000),
    ("national highway", 16.4950, 80.6600),
]
# fixed values: words showing that an address already names its region
REGION_WORDS = [
    "mandal", "district", "commissionerate", "municipality", "rural", "andhra pradesh", "a.p.",
    "a.p", "ntr", "krishna", "vijayawada", "jaggaiahpet", "jaggayyapeta", "nandigama", "tiruvuru",
    "mylavaram", "ibrahimpatnam", "gannavaram", "vuyyuru", "gudivada", "machilipatnam", "nuzvid",
    "kondapalli", "chillakallu", "penamaluru", "mangalagiri", "tadepalli", "kanuru", "nunna",
    "poranki",
]
REGION_SUFFIX = ", Andhra Pradesh, India"
DISTRICT_SUFFIX = ", NTR District, Andhra Pradesh, India"
ADDRESS_PREFIX = (
    r"(?i)^(opp\.?|opposite|near|behind|beside|adj\.?|adjacent|out\s*skirts?\s*(of)?)\s+"
)
GENERIC_ADDRESS_PART = r"(?i)^(nh|national highway|railway|bridge|road)$"

# ---------------------------------------------------------------- report texts
# fixed values: sentences of the rule-based reports; %s takes a profile value
GLOBAL_REPORT = {
    "summary": 'Analysis of accident data from Vijayawada Commissionerate reveals that "%s" is the primary cause of accidents.'
    " The age group %s is most affected, with a fatality rate of %s%%.",
    "key_insights": [
        "Peak accident time: %s", "Highest risk vehicle type: %s", "Hotspot location: %s", "Fatality percentage: %s%%",
    ],
    "policy_recommendations": [
        "Increase patrolling during %s", "Deploy speed cameras near %s", "Target enforcement for %s violations",
        "Conduct regular drunk driving checkpoints",
    ],
    "public_awareness_suggestions": [
        "Awareness campaigns targeting %s age group", "Road safety signage near %s",
        "Promote helmet and seatbelt usage through social media", "Community workshops on defensive driving",
    ],
}
TREND_REPORT = {
    "executive_summary": "Data indicates consistent accident patterns. Peak volume observed on %s.",
    "seasonal_analysis": "Monthly variations follow standard traffic density patterns.",
    "day_of_week_analysis": "Weekends show slightly higher incident rates.",
    "operational_recommendations": ["Maintain standard patrolling schedules.", "Monitor peak hours closey."],
}
JURISDICTION_REPORT = {
    "summary": "Analysis for %s indicates significant accident patterns, primarily late at night or early morning."
    " Enforcement is required on key stretch roads.",
    "key_insights": [
        "The primary cause observed in this jurisdiction is %s.", "The most vulnerable demographic is the %s age group.",
        "Accidents peak during %s.",
    ],
    "policy_recommendations": [
        "Increase nighttime patrolling in %s.", "Engage local community leaders for awareness programs.",
        "Identify and rectify blackspots causing frequent collisions.",
    ],
}
# fixed values: texts that explain an unusual report, and the record line of a digest
ANOMALY_REASONS = {
    "victims": "Unusually high victims (%d)", "vehicles": "Unusually high vehicles (%d)",
    "night": "Occurred at night (00:00–06:00 or 22:00+)", "confidence": "Low AI confidence (%.0f%%)",
    "degree": "Unusually high graph connectivity", "other": "Unusual feature combination",
}
DIGEST_LINE = "- FIR %s (%s): %s accident at %s. Cause: %s"
