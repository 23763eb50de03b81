"""English suffix stemming (the published Porter2 rules without its lists of exceptional words) as SQL expressions over one word column.

A stem is made in steps. Each step is an expression of {w}, the word so far, and of {p1} and {p2}, the lengths after which the regions R1 and R2 of the
word begin; STEPS lists them in order. The expressions use functions that Spark and other SQL engines share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: A word whose last syllable is short: consonant, vowel, consonant other than w, x, y; or a vowel and a consonant alone.
SHORT = f"(^{VOWEL}{OTHER}$)|({OTHER}[aeiouy][^aeiouywx]$)"

# Suffixes of the rules, what takes their place, and where they must stand (1: in R1, 2: in R2).
STEP_2 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"),
    ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"),
]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]
# Words that are neither indexed nor asked for.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "should", "now",
]


def _cut(n: int) -> str:
    return f"left({{w}}, length({{w}}) - {n})"


def _suffixes(rules: list[tuple[str, str, int]], more: str = "") -> str:
    """The longest suffix that the word has decides; it is replaced if it stands in its region."""
    cases = " ".join(f"WHEN right({{w}}, {len(s)}) = '{s}' THEN CASE WHEN length({{w}}) - {len(s)} >= {{p{r}}} THEN {_cut(len(s))} || '{to}' ELSE {{w}} END" for s, to, r in sorted(rules, key=lambda x: -len(x[0])))
    return f"CASE {cases} {more} ELSE {{w}} END"


def _region(word: str, begins: str) -> str:
    found = f"regexp_extract({word}, '^({begins})', 1)"
    return f"CASE WHEN {found} = '' THEN length({word}) ELSE length({found}) END"


#: Lengths of the word before R1 and before R2 (from the start of the word, given that before R1).
R1 = _region("{w}", f"gener|commun|arsen|.*?{VOWEL}{OTHER}")
R2 = f"{{p1}} + {_region('substring({w}, {p1} + 1, 100000)', f'.*?{VOWEL}{OTHER}')}"

_PLURAL = f"""CASE WHEN right({{w}}, 4) = 'sses' THEN {_cut(2)} WHEN right({{w}}, 3) IN ('ied', 'ies') THEN CASE WHEN length({{w}}) > 4 THEN {_cut(2)} ELSE {_cut(1)} END
 WHEN right({{w}}, 2) IN ('us', 'ss') THEN {{w}} WHEN regexp_extract({{w}}, '({VOWEL}.+s)$', 1) <> '' THEN {_cut(1)} ELSE {{w}} END"""
_ENDING = "CASE WHEN right({w}, 5) IN ('eedly', 'ingly') THEN 5 WHEN right({w}, 4) = 'edly' THEN 4 WHEN right({w}, 3) IN ('eed', 'ing') THEN 3 WHEN right({w}, 2) = 'ed' THEN 2 ELSE 0 END"
#: Marked with a '+' at its end where an ending went, for the next step.
_PAST = f"""CASE WHEN right({{w}}, 5) = 'eedly' OR right({{w}}, 3) = 'eed' THEN CASE WHEN length({{w}}) - {_ENDING} >= {{p1}} THEN left({{w}}, length({{w}}) - {_ENDING}) || 'ee' ELSE {{w}} END
 WHEN {_ENDING} > 0 AND regexp_extract(left({{w}}, length({{w}}) - {_ENDING}), '({VOWEL})', 1) <> '' THEN left({{w}}, length({{w}}) - {_ENDING}) || '+' ELSE {{w}} END"""
_REPAIR = f"""CASE WHEN right({{w}}, 1) <> '+' THEN {{w}} WHEN right({{w}}, 3) IN ('at+', 'bl+', 'iz+') THEN {_cut(1)} || 'e' WHEN right({{w}}, 3) IN ('bb+', 'dd+', 'ff+', 'gg+', 'mm+', 'nn+', 'pp+', 'rr+', 'tt+') THEN {_cut(2)}
 WHEN length({{w}}) - 1 <= {{p1}} AND regexp_extract({_cut(1)}, '{SHORT}', 0) <> '' THEN {_cut(1)} || 'e' ELSE {_cut(1)} END"""
_LAST_Y = f"CASE WHEN regexp_extract({{w}}, '(.{OTHER}y)$', 1) <> '' THEN {_cut(1)} || 'i' ELSE {{w}} END"
_LI = f"WHEN right({{w}}, 3) = 'ogi' THEN CASE WHEN right({{w}}, 4) = 'logi' AND length({{w}}) - 3 >= {{p1}} THEN {_cut(1)} ELSE {{w}} END WHEN right({{w}}, 2) = 'li' THEN CASE WHEN regexp_extract({{w}}, '([cdeghkmnrt]li)$', 1) <> '' AND length({{w}}) - 2 >= {{p1}} THEN {_cut(2)} ELSE {{w}} END"
_ION = f"WHEN right({{w}}, 3) = 'ion' THEN CASE WHEN regexp_extract({{w}}, '([st]ion)$', 1) <> '' AND length({{w}}) - 3 >= {{p2}} THEN {_cut(3)} ELSE {{w}} END"
_LAST_E = f"""CASE WHEN right({{w}}, 1) = 'e' AND (length({{w}}) - 1 >= {{p2}} OR length({{w}}) - 1 >= {{p1}} AND regexp_extract({_cut(1)}, '{SHORT}', 0) = '') THEN {_cut(1)}
 WHEN right({{w}}, 2) = 'll' AND length({{w}}) - 1 >= {{p2}} THEN {_cut(1)} ELSE {{w}} END"""

STEPS = [
    _PLURAL, _PAST, _REPAIR, _LAST_Y, _suffixes([(s, to, 1) for s, to in STEP_2], _LI), _suffixes([(s, to, 1) for s, to in STEP_3] + [("ative", "", 2)]), _suffixes([(s, "", 2) for s in STEP_4], _ION), _LAST_E,
]


def stem(word: str) -> Column:
    """The stem of a column of lower-case words; words of one or two letters stay, as do words of other letters than a to z.

    The steps are bound as variables of a one-element array, so that none is written out more than once in the plan.
    """
    names = dict(w="s.w", p1="s.p1", p2="s.p2")
    bound = f"transform(array({word}), w -> named_struct('w', w, 'p1', {R1.format(w='w')}))"
    bound = f"transform({bound}, s -> named_struct('w', s.w, 'p1', s.p1, 'p2', {R2.format(**names)}))"
    for step in STEPS:
        bound = f"transform({bound}, s -> named_struct('w', {step.format(**names)}, 'p1', s.p1, 'p2', s.p2))"
    return F.expr(f"CASE WHEN length({word}) > 2 AND {word} RLIKE '^[a-z]+$' THEN ({bound})[0].w ELSE {word} END")
