"""Small parameter tables: lexicon, entity taxonomy, title phrases, community list, word lists.

Everything here is a *parameter*: callers may pass their own frames instead. The values below
are bounded (tens of rows) and are turned into broadcastable frames by ``sources.params``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's for equal results).
# Entity taxonomy: family, label and its any-of patterns, in declaration order. Matching is
# on the lower-cased text; a label is tagged when any of its patterns is found.
# ---------------------------------------------------------------------------------------------
TAXONOMY = [
    ("vehicles", "model_3", [r"model\s*3", r"\bm3\b", r"model3"]),
    ("vehicles", "model_s", [r"model\s*s\b", r"models(?!\w)"]),
    ("vehicles", "model_x", [r"model\s*x", r"modelx\b", r"\bmx\b"]),
    ("vehicles", "model_y", [r"model\s*y", r"modely\b", r"\bmy\b"]),
    ("vehicles", "cybertruck", [r"cybertruck", r"cyber\s*truck"]),
    ("vehicles", "roadster", [r"roadster"]),
    ("vehicles", "semi", [r"semi(?:\s+truck)?"]),
    ("energy_products", "powerwall", [r"powerwall", r"\bpw2\b", r"\bpw3\b"]),
    ("energy_products", "powerwall_2", [r"powerwall\s*2", r"\bpw2\b"]),
    ("energy_products", "powerwall_3", [r"powerwall\s*3", r"\bpw3\b"]),
    ("energy_products", "solar_panels", [r"solar\s+panel", r"solar\s+array", r"\bpv\s+panel"]),
    ("energy_products", "solar_roof", [r"solar\s+roof", r"solar\s+tiles?"]),
    ("energy_products", "megapack", [r"megapack"]),
    ("energy_products", "megawatt", [r"megawatt"]),
    ("energy_products", "supercharger", [r"supercharger", r"\bsc\s+v[234]", r"super\s+charger"]),
    ("issues", "recall", [r"\brecall", r"\btsb\b", r"service\s+bulletin"]),
    ("issues", "fire", [r"\bfire", r"\bburn(?:ing)?", r"flame", r"combustion", r"ignit"]),
    ("issues", "accident", [r"accident", r"crash", r"collision", r"wreck"]),
    ("issues", "safety", [r"safety\s+(?:issue|concern|hazard)", r"dangerous", r"hazard"]),
    ("issues", "service", [r"service\s+center", r"mobile\s+service", r"repair\s+(?:shop|center)"]),
    ("issues", "warranty", [r"warranty", r"out\s+of\s+warranty", r"extended\s+warranty"]),
    ("issues", "battery_issue", [r"battery\s+(?:degradation|issue|problem|fail)", r"range\s+loss"]),
    ("issues", "autopilot", [r"autopilot", r"\bfsd\b", r"full\s+self[\s-]driving"]),
    ("issues", "charging_issue", [r"charging\s+(?:issue|problem|error)", r"won\'?t\s+charge", r"charging\s+fail"]),
    ("issues", "inspection_failure", [r"inspection\s+fail", r"failed\s+inspection", r"nyserda"]),
]
FAMILIES = ["vehicles", "energy_products", "issues"]

# FIXED VALUES: the community target list (ingest side), in declaration order.
COMMUNITIES = [
    "TeslaMotors", "solar", "TeslaEnergy", "Powerwall", "electricvehicles", "renewable", "TeslaLounge",
    "TeslaModel3", "TeslaModelS", "TeslaModelX", "TeslaModelY", "Superchargers", "TeslaSupport", "electriccars",
]

# FIXED VALUE: communities that the completeness check expects.
EXPECTED_COMMUNITIES = 6

# FIXED VALUES: product display lists of the products page (vehicle / energy categories).
VEHICLE_DISPLAY = ["Model Y", "Model 3", "Model S", "Model X", "Cybertruck"]
ENERGY_DISPLAY = ["Powerwall", "Solar Panels", "Solar Roof", "Megapack"]

# ---------------------------------------------------------------------------------------------
# Test fixtures of our own (FIXTURES.md §5, §6): title phrases and a small valence lexicon.
# ---------------------------------------------------------------------------------------------
PHRASES = [
    "Powerwall 2 recall after fire hazard, terrible news",
    "Love my Model 3, amazing drive",
    "Solar roof install went great",
    "Supercharger broken again, worst charging issue",
    "Cybertruck delivery date",
    "Battery degradation problem on Model S, angry",
    "Great range on the Model Y, best car so far",
    "FSD nearly caused a crash, awful",
    "Mobile service fixed it, happy with the warranty",
    "Weekly question thread",
    "Megapack project announced",
    "Failed inspection on the solar panel, bad installer",
    "Roadster rumour roundup",
]

LEXICON = [
    ("best", 3.2), ("great", 3.1), ("love", 3.2), ("amazing", 2.8), ("happy", 2.7),
    ("worthless", -1.9), ("terrible", -2.1), ("awful", -2.0), ("worst", -3.1), ("bad", -2.5),
    ("angry", -2.3), ("broken", -1.2), ("problem", -1.7), ("failed", -2.3), ("hazard", -1.5),
    ("recall", -0.8),
]

# Scorer constants of the published rule-based method (Hutto & Gilbert, ICWSM 2014).
NEGATION_SCALAR = -0.74
BOOSTER_INCR = 0.293
CAPS_INCR = 0.733
EXCLAMATION_STEP = 0.292
EXCLAMATION_MAX = 4
NORMALIZE_ALPHA = 15.0
CONTRAST_BEFORE = 0.5
CONTRAST_AFTER = 1.5
# Context word lists (ours, short): negators, intensifiers, dampeners.
NEGATORS = [
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "cannot", "without",
    "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't",
    "couldn't", "shouldn't", "hasn't", "haven't", "hadn't", "ain't",
]
BOOSTERS_UP = [
    "very", "really", "extremely", "so", "totally", "absolutely", "incredibly", "super", "completely",
    "highly", "truly", "especially", "hugely", "most", "more",
]
BOOSTERS_DOWN = ["slightly", "somewhat", "barely", "hardly", "marginally", "little", "less", "partly", "scarcely"]


# Spark ML's default English stop words (StopWordsRemover.loadDefaultStopWords("english")).
ENGLISH_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll
    she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
    shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's
    who's why's would
""".split()


def english_stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop-word list (181 words), kept here so that no file is read at import.

    Differs from scikit-learn's 318-word list (contractions instead of e.g. 'amongst'), which
    changes which terms survive; callers may pass their own list.
    """
    return tuple(ENGLISH_STOP_WORDS)


# ---------------------------------------------------------------------------------------------
# Portable regular expressions. Java (Spark) and RE2 (the SQL oracle) differ on \b and \w for
# non-ASCII text and RE2 has no look-around. Patterns are matched on lower-cased text for a
# yes/no answer only, so boundaries may consume a character; we spell them as ASCII classes so
# both engines give the same answer.
# ---------------------------------------------------------------------------------------------
_WORD = "a-z0-9_"
_SPACE = r"[ \t\n\x0B\f\r]"


def portable_regex(pattern: str) -> str:
    out = pattern.replace(r"(?!\w)", f"(?:$|[^{_WORD}])")
    out = out.replace(r"[\s-]", r"[ \t\n\x0B\f\r-]")
    out = out.replace(r"\s", _SPACE)
    out = out.replace(r"\'", "'")
    if out.startswith(r"\b"):
        out = f"(?:^|[^{_WORD}])" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + f"(?:$|[^{_WORD}])"
    assert r"\b" not in out and r"\w" not in out, pattern
    return out


def required_literal(pattern: str) -> str:
    """A substring every match of ``pattern`` must contain (for a cheap ``instr`` prefilter).

    Rule: drop boundaries, optional groups, alternation groups and character classes; a token
    directly followed by ``?``/``*`` loses its last character; take the longest remaining run
    of letters and digits.
    """
    import re

    p = pattern.replace(r"(?!\w)", " ").replace(r"\b", " ").replace(r"\'", " ")
    p = re.sub(r"\(\?:[^()]*\)[?*]", " ", p)
    p = re.sub(r"\(\?:[^()]*\|[^()]*\)", " ", p)
    p = re.sub(r"\[[^\]]*\]", " ", p)
    p = re.sub(r"\\[a-zA-Z]", " ", p)
    p = re.sub(r"([a-z0-9])[?*]", " ", p)
    runs = re.findall(r"[a-z0-9]+", p)
    if not runs:
        raise ValueError(f"no literal in {pattern!r}")
    return max(runs, key=len)


def label_literals(patterns: list[str]) -> list[str]:
    return sorted({required_literal(p) for p in patterns})


def search_regex(pattern: str) -> str | None:
    """``portable_regex`` for a search by Java, which finds the same texts; None where the required literal alone decides.

    An optional group at the end decides nothing. A leading boundary is looked at behind its word, so that the
    search is one for a literal (by skipping) instead of a choice at each place of the text.
    """
    import re

    p = re.sub(r"\(\?:[^()]*\)\?$", "", pattern)
    if p == required_literal(pattern):
        return None
    found, start = portable_regex(p), f"(?:^|[^{_WORD}])"
    m = re.match(r"[a-z0-9]+(?![?*+{])", found[len(start):]) if found.startswith(start) else None
    return found if m is None else f"{m[0]}(?<![{_WORD}]{m[0]})" + found[len(start) + m.end():]


def label_regex(patterns: list[str]) -> str:
    """One alternation per label: any-of semantics in a single regex pass."""
    return "|".join(f"(?:{portable_regex(p)})" for p in patterns)


def taxonomy_rows() -> list[tuple[str, str, int, str]]:
    """(family, label, ord, pattern) rows; ord is the declaration order inside the family."""
    rows, seen = [], {f: 0 for f in FAMILIES}
    for family, label, patterns in TAXONOMY:
        rows.append((family, label, seen[family], label_regex(patterns)))
        seen[family] += 1
    return rows


def taxonomy_literals() -> dict[str, list[str]]:
    """label → literals, one of which every match contains."""
    return {label: label_literals(patterns) for _, label, patterns in TAXONOMY}


def taxonomy_searches() -> dict[str, list[tuple[str, list[str]]]]:
    """label → (literal, regexes): the label is found where a literal is, and one of its regexes, if it has any."""
    out: dict[str, list[tuple[str, list[str]]]] = {}
    for _, label, patterns in TAXONOMY:
        by: dict[str, list[str | None]] = {}
        for p in patterns:
            by.setdefault(required_literal(p), []).append(search_regex(p))
        out[label] = [(lit, [] if None in found else found) for lit, found in by.items()]
    return out


#: A lexicon of another domain, for queries that pass one (ours).
SERVICE_LEXICON = [
    ("recall", -2.0), ("fire", -2.5), ("crash", -2.5), ("broken", -1.5), ("failed", -2.0), ("hazard", -2.0), ("issue", -1.0),
    ("fixed", 1.8), ("warranty", 0.5), ("happy", 2.0), ("delivery", 0.4), ("installer", -0.3),
]
