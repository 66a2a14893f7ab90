"""Text functions, each from columns to a column: inside the JVM, but for the normaliser's words, which go through Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, as the inside of a character class (fixed values; written so that Java's and RE2's regular expressions agree).
SPACES = r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: English stop words of the normaliser (fixed values).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above "
    "below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't "
    "doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't "
    "weren weren't won won't wouldn wouldn't"
).split()
#: Words of it that the normaliser keeps, as they carry sentiment (fixed values).
KEPT_WORDS = ["not", "but", "however", "no", "yet"]
#: Punctuation that is counted (fixed values).
PUNCTUATION = ".,!?;:\"'()[]{}-"
#: English stop words of vectorizers, a public list (fixed values).
VECTORIZER_STOP_WORDS = (
    "a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and another any "
    "anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind being below beside besides "
    "between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during each eg eight either eleven else "
    "elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former formerly forty found four "
    "from front full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if "
    "in inc indeed interest into is it its itself keep last latter latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move "
    "much must my myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only onto or other "
    "others otherwise our ours ourselves out over own part per perhaps please put rather re same see seem seemed seeming seems serious several she should show side "
    "since sincere six sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the their them themselves then thence "
    "there thereafter thereby therefore therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward "
    "towards twelve twenty two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon "
    "wherever whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves"
).split()
#: Suffix rules for nouns, tried against a lexicon (fixed values); the last two are added for plurals that lists of exceptions have elsewhere.
NOUN_RULES = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("oes", "o"), ("zzes", "z")]
#: Irregular plurals, and words that look like plurals but are none (fixed values).
NOUN_EXCEPTIONS = {
    "aches": "ache", "calves": "calf", "children": "child", "cookies": "cookie", "elves": "elf", "feet": "foot", "geese": "goose", "halves": "half", "knives": "knife",
    "leaves": "leaf", "lives": "life", "loaves": "loaf", "men": "man", "mice": "mouse", "movies": "movie", "oxen": "ox", "people": "people", "scarves": "scarf", "selfies": "selfie",
    "shelves": "shelf", "teeth": "tooth", "thieves": "thief", "wives": "wife", "wolves": "wolf", "zombies": "zombie",
}
NO_PLURALS = "abdomen acumen always amen besides cosmos gas lens news omen perhaps ramen regimen series sometimes specimen species thus towards whereas".split()
#: Words of a vectorizer: two or more letters, numbers or underscores in a row.
_ANALYZER = r"[\p{L}\p{N}_]{2,}"


def removed_stop_words() -> list[str]:
    return [w for w in STOP_WORDS if w not in KEPT_WORDS]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def newline_to_space(c: Column) -> Column:
    return F.translate(c, "\n", " ")


def whitelist(c: Column) -> Column:
    """Delete all but ASCII letters, digits, white space and ``! ? . ,``."""
    return F.regexp_replace(c, f"[^A-Za-z0-9!?.,{SPACES}]+", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"[{SPACES}]+"), lambda t: t != "")


def without(words: Column, stop: Iterable[str]) -> Column:
    held = list(stop)
    return F.filter(words, lambda t: ~t.isin(held))


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


#: White space beyond ASCII, and how ASCII goes through the whitelist: white space to blanks, the rest but for what is kept deleted.
_WIDE_SPACE = re.compile(r"[^\S\x00-\x7F]")
_BLANKS = bytes(0x20 if chr(k).isspace() else k for k in range(256))
_DELETED = bytes(k for k in range(128) if not (chr(k).isalnum() or chr(k).isspace() or chr(k) in "!?.,"))


def _cleaner():
    """A function of lower-case texts, in Arrow batches; what Python takes for white space is SPACES (a test)."""
    removed = frozenset(removed_stop_words())

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        def of(t: str) -> str:
            held = t if t.isascii() else _WIDE_SPACE.sub(" ", t)
            left = held.encode("ascii", "ignore").translate(_BLANKS, _DELETED).decode("ascii")
            return " ".join([w for w in left.split() if w not in removed])

        return pa.array([None if t is None else of(t) for t in (x.as_py() for x in texts)], pa.string())

    return cleaned


def clean(c: Column) -> Column:
    """Lower case, strip, newlines to spaces, whitelist, stop words: the normaliser before its lemmas.  Null stays null."""
    return _cleaner()(F.lower(c))


def cleaned_words(c: Column) -> Column:
    """The words of a cleaned or normalised text, which single blanks part."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def stop_word_count(c: Column) -> Column:
    """Words in the full stop list, kept ones too."""
    return F.size(F.filter(tokens(c), lambda t: t.isin(STOP_WORDS)))


def punctuation_count(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.translate(c, PUNCTUATION, ""))


def analyzed(c: Column) -> Column:
    """The words that a vectorizer takes: lower case, two word characters or more."""
    return F.regexp_extract_all(F.lower(c), F.lit(_ANALYZER), F.lit(0))


def ngrams(words: Column, lo: int, hi: int) -> Column:
    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(lo, hi + 1)]) if hi > lo else of(lo)


def let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once: inside a lambda function Spark would compute an expression for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(c: Column, digits: int = 2) -> Column:
    """Fixed-point rounding, half up, of a decimal."""
    return F.round(c.cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})")


def percent_label(p: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(p, 1))  # halves to even, as C rounds them
