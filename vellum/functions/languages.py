"""Lookup tables of languages. Fixed values."""

ORIENTATION = {
    "CHS": "auto", "CHT": "auto", "CSY": "h", "NLD": "h", "ENG": "h", "FRA": "h", "DEU": "h", "HUN": "h", "ITA": "h", "JPN": "auto", "KOR": "h",
    "POL": "h", "PTB": "h", "ROM": "h", "RUS": "h", "ESP": "h", "TRK": "h", "UKR": "h", "VIN": "h", "ARA": "hr", "FIL": "h",
}
NAMES = {
    "CHS": "Chinese (Simplified)", "CHT": "Chinese (Traditional)", "CSY": "Czech", "NLD": "Dutch", "ENG": "English", "FRA": "French", "DEU": "German",
    "HUN": "Hungarian", "ITA": "Italian", "JPN": "Japanese", "KOR": "Korean", "POL": "Polish", "PTB": "Portuguese (Brazil)", "ROM": "Romanian",
    "RUS": "Russian", "ESP": "Spanish", "TRK": "Turkish", "UKR": "Ukrainian", "VIN": "Vietnamese", "ARA": "Arabic", "THA": "Thai", "IND": "Indonesian",
    "FIL": "Filipino (Tagalog)",
}
FROM_ISO = {
    "zh": "CHS", "ja": "JPN", "en": "ENG", "ko": "KOR", "vi": "VIN", "cs": "CSY", "nl": "NLD", "fr": "FRA", "de": "DEU", "hu": "HUN", "it": "ITA",
    "pl": "POL", "pt": "PTB", "ro": "ROM", "ru": "RUS", "es": "ESP", "tr": "TRK", "uk": "UKR", "ar": "ARA", "th": "THA", "id": "IND", "tl": "FIL",
}
