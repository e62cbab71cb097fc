"""Values that results depend on and that cannot be derived."""

# Earth radius in km and the accuracy thresholds in km.
EARTH_RADIUS_KM = 6371.0
ACCURACY_KM = (1, 25, 200, 750, 2500)

# Prior truncation and temperature, score smoothing.
PRIOR_TRUNCATION = 0.6
PRIOR_TEMPERATURE = 1.5
SCORE_SMOOTHING = 0.02

# Thresholds of the sequential rules.
STOP_PROBABILITY = 0.7
STALL_CHANGE = 0.05
KEY_BITS = 1.0

# Levels, coarse to fine.
LEVELS = ("country", "city", "street")

# Address fields in order of preference for a place name.
PLACE_FIELDS = ("city", "town", "village", "municipality", "county", "state_district", "state", "region")

# Country names and the name they are reported under.
COUNTRY_ALIASES = {
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "united kingdom": "United Kingdom",
    "great britain": "United Kingdom",
    "britain": "United Kingdom",
    "scotland": "United Kingdom",
    "england": "United Kingdom",
    "wales": "United Kingdom",
    "northern ireland": "United Kingdom",
    "usa": "United States",
    "u.s.": "United States",
    "u.s.a.": "United States",
    "us": "United States",
    "united states": "United States",
    "united states of america": "United States",
    "america": "United States",
    "prc": "China",
    "people's republic of china": "China",
    "mainland china": "China",
    "south korea": "South Korea",
    "republic of korea": "South Korea",
    "holland": "Netherlands",
    "the netherlands": "Netherlands",
    "uae": "United Arab Emirates",
    "russia": "Russia",
    "russian federation": "Russia",
    "czechia": "Czech Republic",
    "türkiye": "Turkey",
    "turkiye": "Turkey",
    "burma": "Myanmar",
    "côte d'ivoire": "Ivory Coast",
}

# Words left out of the cue term counts.
CUE_STOP_WORDS = ("on", "in", "the", "a", "of", "with", "and", "style", "an", "at", "for")
