"""Word lists of the data format.

Everything in this module is a fixed value: results equal only with these very words, in this order (long
forms stand before their prefixes, and the first context key that is found decides a number's role).
"""

from __future__ import annotations

MUSCLES = ["GGP", "GGM", "GGA", "STY", "GH", "MH", "HG", "VERT", "TRANS", "IL", "SL"]

FULL_NAMES = {
    "en": {
        "GGP": "genioglossus posterior (GGP)",
        "GGM": "genioglossus medius (GGM)",
        "GGA": "genioglossus anterior (GGA)",
        "STY": "styloglossus (STY)",
        "GH": "geniohyoid (GH)",
        "MH": "mylohyoid (MH)",
        "HG": "hyoglossus (HG)",
        "VERT": "verticalis (VERT)",
        "TRANS": "transversus (TRANS)",
        "IL": "inferior longitudinal (IL)",
        "SL": "superior longitudinal (SL)",
    },
    "ko": {
        "GGP": "이설근 후부(genioglossus posterior)",
        "GGM": "이설근 중부(genioglossus medius)",
        "GGA": "이설근 전부(genioglossus anterior)",
        "STY": "경돌설근(styloglossus)",
        "GH": "이설골근(geniohyoid)",
        "MH": "악설골근(mylohyoid)",
        "HG": "설골설근(hyoglossus)",
        "VERT": "수직근(verticalis)",
        "TRANS": "횡근(transversus)",
        "IL": "하종설근(inferior longitudinal)",
        "SL": "상종설근(superior longitudinal)",
    },
}

MOVEMENTS = {
    "en": ["monotonically increases", "monotonically", "increases", "increase", "consistent", "preserved", "compensate", "offsets", "retract", "raise", "rises", "domed", "lower", "flattened", "advance", "saturation", "reversal", "negligible"],
    "ko": ["단조적으로 증가", "단조 증가", "전진", "후퇴", "상승", "하강", "보존", "보상", "상쇄", "증가", "감소", "포화", "역전", "납작", "아치", "단조", "narrow"],
}
REGION_WORDS = {"en": ["front", "mid", "back"], "ko": ["front", "mid", "back", "전방", "중간", "후방"]}

_SHARED_ROLES = [("cl_t", "cl_t"), ("cd_min", "cd_min"), ("peak_xn", "peak_xn"), ("peak_z", "peak_z"), ("tilt", "tilt"), ("arc_len", "arc_len"), ("curv_peak", "curv_peak"), ("vol_ratio", "vol_ratio"), ("ρ", "rho"), ("dx", "dx_mm"), ("dz", "dz_mm"), ("mm", "disp_mm")]
ROLES = {"en": [("doming", "doming"), *_SHARED_ROLES, ("->", "disp_mm")], "ko": [("도밍", "doming"), *_SHARED_ROLES, ("→", "disp_mm")]}

MOVEMENT_CONCEPTS = {
    "en": {
        "monotonically increases": ["mono", "inc"],
        "monotonically": ["mono"],
        "increases": ["inc"],
        "increase": ["inc"],
        "consistent": ["consistent"],
        "preserved": ["preserve"],
        "compensate": ["compensate"],
        "offsets": ["cancel"],
        "retract": ["retract"],
        "raise": ["elevate"],
        "rises": ["elevate"],
        "domed": ["arch"],
        "lower": ["descend"],
        "flattened": ["flat"],
        "advance": ["advance"],
        "saturation": ["saturate"],
        "reversal": ["reverse"],
        "negligible": ["negligible"],
    },
    "ko": {
        "단조적으로 증가": ["mono", "inc"],
        "단조 증가": ["mono", "inc"],
        "단조": ["mono"],
        "전진": ["advance"],
        "후퇴": ["retract"],
        "상승": ["elevate"],
        "하강": ["descend"],
        "보존": ["preserve"],
        "보상": ["compensate"],
        "상쇄": ["cancel"],
        "증가": ["inc"],
        "감소": ["dec"],
        "포화": ["saturate"],
        "역전": ["reverse"],
        "납작": ["flat"],
        "아치": ["arch"],
        "narrow": ["narrow"],
    },
}
# Concepts that contradict each other in a statement of direction.
OPPOSITE_CONCEPTS = {"advance": "retract", "retract": "advance", "elevate": "descend", "descend": "elevate", "inc": "dec", "dec": "inc", "flat": "arch", "arch": "flat"}
# How far from a verb a muscle may stand, in characters: after it in a list, before it in Korean, on either side by nearness.
LIST_REACH, KO_REACH, NEAR_REACH = 120, 160, 45
REGION_CONCEPTS = {"en": {"front": "front", "mid": "mid", "back": "back"}, "ko": {"front": "front", "전방": "front", "mid": "mid", "중간": "mid", "back": "back", "후방": "back"}}

ABSTENTIONS = {
    "en": [r"can(?:no|')?t be determined", r"cannot be", r"not unique", r"motor equivalen", r"no,? it can'?t", r"not possible to tell", r"insufficient", r"ambiguous", r"more than one .{0,20}combination", r"different .{0,25}combinations"],
    "ko": [r"판단할 수 없", r"판단 불가", r"알 수 없", r"유일하지 않", r"비유일", r"운동 등가", r"결정할 수 없", r"여러 .{0,15}조합"],
}
SIGNS = [
    (r"super-?additive|synerg|coopera|amplif|greater than the (linear )?sum|exceeds? the (linear )?sum|more than the sum|초가법|협동|상승작용", "+"),
    (r"sub-?additive|antagon|oppos|cancel|less than the (linear )?sum|offset|smaller than the sum|길항|상쇄|저가법", "-"),
    (r"\badditive\b|equal to the sum|about the sum|roughly the sum|matches the (linear )?superposition|linear|가법적|선형 중첩", "0"),
]
TRENDS = [("reverse", "reversal"), ("saturate", "saturating"), ("mono", "monotonic")]

REGIONS = ["tip", "body", "root", "dorsum"]
REGION_ALIASES = {
    "tip": "tip",
    "body": "body",
    "root": "root",
    "dorsum": "dorsum",
    "front": "tip",
    "mid": "body",
    "middle": "body",
    "back": "root",
    "anterior": "tip",
    "posterior": "root",
    "설첨": "tip",
    "설체": "body",
    "설근": "root",
    "설배": "dorsum",
    "앞": "tip",
    "중간": "body",
    "뒤": "root",
}
DIRECTION_SURFACES = {
    "advance": "advance",
    "protrud": "advance",
    "forward": "advance",
    "retract": "retract",
    "backward": "retract",
    "elevate": "elevate",
    "rais": "elevate",
    "upward": "elevate",
    "descend": "descend",
    "depress": "descend",
    "lower": "descend",
    "preserve": "preserve",
    "unchanged": "preserve",
    "no change": "preserve",
    "negligible": "preserve",
    "stay": "preserve",
    "전진": "advance",
    "전방": "advance",
    "돌출": "advance",
    "후퇴": "retract",
    "후방": "retract",
    "상승": "elevate",
    "올림": "elevate",
    "거상": "elevate",
    "하강": "descend",
    "내림": "descend",
    "하방": "descend",
    "유지": "preserve",
    "변화 없": "preserve",
    "거의 없": "preserve",
}
#: Number patterns of the two axes, with the concepts of a positive and a negative value.
AXIS_NUMBERS = [
    (r"(?:\bdx\b|forward(?:_mm)?|ap)\s*[=:]?\s*([+-]?\d+(?:\.\d+)?)", "advance", "retract"),
    (r"(?:\bdz\b|up(?:_mm)?|vertical)\s*[=:]?\s*([+-]?\d+(?:\.\d+)?)", "elevate", "descend"),
]
AXIS_PAIR = r"\bdx\b[^0-9+-]{0,6}([+-]?\d+(?:\.\d+)?)\s*(?:mm)?\s*[,/]\s*(?:\bdz\b[^0-9+-]{0,6})?([+-]?\d+(?:\.\d+)?)"
MOVE_EPS_MM = 0.5

MUSCLE_SURFACES = {
    "genioglossus posterior": "GGP",
    "genioglossus medius": "GGM",
    "genioglossus anterior": "GGA",
    "styloglossus": "STY",
    "geniohyoid": "GH",
    "mylohyoid": "MH",
    "hyoglossus": "HG",
    "verticalis": "VERT",
    "transversus": "TRANS",
    "inferior longitudinal": "IL",
    "superior longitudinal": "SL",
    "이설근 후부": "GGP",
    "이설근 중부": "GGM",
    "이설근 전부": "GGA",
    "경돌설근": "STY",
    "이설골근": "GH",
    "악설골근": "MH",
    "설골설근": "HG",
    "수직근": "VERT",
    "횡근": "TRANS",
    "하종설근": "IL",
    "상종설근": "SL",
}
MORE_VERBS = r"increase|raise|contract(?:\s+more)?|activate|strengthen|tighten|더\s*수축|증가|올려"
LESS_VERBS = r"decrease|relax|reduce|lower|release|deactivate|이완|감소|내려|낮(?:추|춰|추어)|풀"
KO_MORE_VERBS = r"더\s*수축|수축|증가|올려|활성"
KO_LESS_VERBS = r"이완|감소|내려|낮(?:추|춰|추어)|풀"

CONTOUR_FEATURES = ["cd_min", "cl_t", "gap_mean", "gap_std", "gap_front", "gap_mid", "gap_back", "constr_width", "df_0", "df_1", "df_2", "df_3", "df_4", "df_5", "df_6", "df_7", "tip_xn", "tip_z", "peak_xn", "peak_z", "h_front", "h_mid", "h_back", "mean_z", "com_xn", "com_z", "arc_len", "tilt", "ant_slope", "post_slope", "curv_peak", "doming"]
