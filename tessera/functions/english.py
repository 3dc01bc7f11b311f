"""English analysis of search terms: stop words, and the published Porter 2 stemming rules as SQL expressions.

Every step is a named expression over the steps before, in words that Spark and other SQL engines share, so an
index, its queries and the SQL they are held against use one set of rules. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what a term is. Dashed terms are whole and in parts, dotted ones whole.
TERM = r"[\p{L}\p{N}]++(?:[.-][\p{L}\p{N}]++)*+"
#: The usual English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: Words with a stem of their own, words that keep their form, and words that stop after the plural.
OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = "sky news howe atlas cosmos bias andes".split()
KEPT_AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed".split()
#: Suffixes of the second and third step and what they become, and those that the fourth step drops.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = f"^{_C}*{_V}+{_C}"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _has(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '{pattern}', 0) <> ''"


def _end(w: str, suffixes, when: str = "TRUE") -> str:
    """The longest of the suffixes that w ends in; a search from the left finds the longest first."""
    return f"CASE WHEN {when} THEN regexp_extract({w}, '({'|'.join(suffixes)})$', 1) ELSE '' END"


def _cut(w: str, s: str) -> str:
    return f"substr({w}, 1, length({w}) - length({s}))"


def _becomes(s: str, table: dict[str, str]) -> str:
    return f"CASE {s} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE '' END"


def _short(w: str) -> str:
    """The word ends in a short syllable."""
    return f"({_has(w, f'{_C}{_V}[^aeiouywxY]$')} OR {_has(w, f'^{_V}{_C}$')})"


def _marked(w: str) -> str:
    """y counts as a consonant at the beginning and behind a vowel: it is written Y there."""
    out = f"CASE WHEN substr({w}, 1, 1) = 'y' THEN concat('Y', substr({w}, 2)) ELSE {w} END"
    for v in "aeiouy":
        out = f"replace({out}, '{v}y', '{v}Y')"
    return out


def steps(term: str) -> list[tuple[str, str]]:
    """Names and expressions, each over those before it; the last, ``lexeme``, is null for stop words."""
    seen = "length(w1a) > p1 + 1"
    return [
        # Only words of letters are stemmed; words of one or two letters and words with rules of their own aren't.
        ("plain", f"length({term}) > 2 AND regexp_extract({term}, '[0-9.-]', 0) = '' AND {term} NOT IN ({_quoted([*STOP_WORDS, *OWN_STEMS, *KEPT])})"),
        ("w0", f"CASE WHEN plain THEN {_marked(term)} ELSE '' END"),
        ("m1", f"CASE WHEN {_has('w0', '^(gener|commun|arsen)')} THEN regexp_extract(w0, '^(gener|commun|arsen)', 1) ELSE regexp_extract(w0, '{_REGION}', 0) END"),
        ("p1", "CASE WHEN m1 = '' THEN length(w0) ELSE length(m1) END"),
        ("m2", f"regexp_extract(substr(w0, p1 + 1), '{_REGION}', 0)"),
        ("p2", "CASE WHEN m2 = '' THEN length(w0) ELSE p1 + length(m2) END"),
        ("s1a", _end("w0", ("sses", "ied", "ies", "us", "ss", "s"), "substr(w0, length(w0), 1) IN ('s', 'd')")),
        ("w1a", f"""CASE WHEN s1a = 'sses' THEN {_cut("w0", "'es'")} WHEN s1a IN ('ied', 'ies') THEN concat({_cut("w0", "s1a")}, CASE WHEN length(w0) > 4 THEN 'i' ELSE 'ie' END)
            WHEN s1a = 's' AND {_has("substr(w0, 1, length(w0) - 2)", _V)} THEN {_cut("w0", "s1a")} ELSE w0 END"""),
        ("s1b", _end("w1a", ("eedly", "ingly", "edly", "eed", "ing", "ed"), f"w1a NOT IN ({_quoted(KEPT_AFTER_PLURAL)}) AND substr(w1a, length(w1a), 1) IN ('d', 'g', 'y')")),
        ("c1b", f"CASE WHEN s1b NOT IN ('', 'eed', 'eedly') AND {_has(_cut('w1a', 's1b'), _V)} THEN {_cut('w1a', 's1b')} ELSE '' END"),
        ("w1b", f"""CASE WHEN s1b IN ('eed', 'eedly') THEN CASE WHEN length(w1a) - length(s1b) >= p1 THEN concat({_cut("w1a", "s1b")}, 'ee') ELSE w1a END
            WHEN c1b = '' THEN w1a WHEN {_has("c1b", "(at|bl|iz)$")} THEN concat(c1b, 'e')
            WHEN {_has("c1b", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")} THEN {_cut("c1b", "'x'")} WHEN p1 >= length(c1b) AND {_short("c1b")} THEN concat(c1b, 'e') ELSE c1b END"""),
        ("w1c", f"CASE WHEN substr(w1b, length(w1b), 1) IN ('y', 'Y') AND {_has('w1b', f'^.+{_C}[yY]$')} THEN concat({_cut('w1b', chr(39) + 'y' + chr(39))}, 'i') ELSE w1b END"),
        ("s2", _end("w1c", SECOND, seen)),
        ("ok2", f"""s2 <> '' AND length(w1c) - length(s2) >= p1 AND CASE s2 WHEN 'ogi' THEN {_has("w1c", "logi$")} WHEN 'li' THEN {_has("w1c", "[cdeghkmnrt]li$")} ELSE TRUE END"""),
        ("w2", f"CASE WHEN ok2 THEN concat({_cut('w1c', 's2')}, {_becomes('s2', SECOND)}) ELSE w1c END"),
        ("s3", _end("w2", THIRD, seen)),
        ("w3", f"CASE WHEN s3 <> '' AND length(w2) - length(s3) >= CASE s3 WHEN 'ative' THEN p2 ELSE p1 END THEN concat({_cut('w2', 's3')}, {_becomes('s3', THIRD)}) ELSE w2 END"),
        ("s4", _end("w3", FOURTH, "length(w3) > p2 + 1")),
        ("w4", f"CASE WHEN s4 <> '' AND length(w3) - length(s4) >= p2 AND (s4 <> 'ion' OR {_has('w3', '[st]ion$')}) THEN {_cut('w3', 's4')} ELSE w3 END"),
        ("w5", f"""CASE substr(w4, length(w4), 1) WHEN 'e' THEN CASE WHEN length(w4) > p2 OR (length(w4) > p1 AND NOT {_short(_cut("w4", "'e'"))}) THEN {_cut("w4", "'e'")} ELSE w4 END
            WHEN 'l' THEN CASE WHEN length(w4) > p2 AND {_has("w4", "ll$")} THEN {_cut("w4", "'l'")} ELSE w4 END ELSE w4 END"""),
        ("lexeme", f"""CASE WHEN {term} IN ({_quoted(STOP_WORDS)}) THEN NULL WHEN NOT plain THEN CASE {term} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OWN_STEMS.items())} ELSE {term} END
            WHEN w1a IN ({_quoted(KEPT_AFTER_PLURAL)}) THEN w1a ELSE replace(w5, 'Y', 'y') END"""),
    ]


def with_lexemes(df: DataFrame, term: str = "term") -> DataFrame:
    """df with ``lexeme``, the stem of the lower-cased term; without the rows of empty terms and stop words.

    Write what comes out before filtering or joining by lexeme: a filter that is pushed down through the steps would
    repeat all of them.
    """
    out = df.where((F.col(term) != "") & ~F.col(term).isin(*STOP_WORDS))
    for name, expression in steps(term):
        out = out.withColumn(name, F.expr(expression))
    return out.select(*df.columns, "lexeme")


def lexemes_sql(table: str, columns: str, term: str = "term") -> str:
    """The same over a table of another SQL engine: ``columns`` and lexeme."""
    out = f"SELECT {columns} FROM {table}"
    for name, expression in steps(term):
        out = f"SELECT *, {expression} AS {name} FROM ({out})"
    return f"SELECT {columns}, lexeme FROM ({out})"


def positioned(text: Column) -> Column:
    """All terms in order, ``/`` and ``_`` as separators; a dashed one is followed by its parts. The index is the position."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))
    return F.flatten(F.transform(found, lambda t: F.when(t.contains("-"), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))))
