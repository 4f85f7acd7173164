"""Text analysis as column expressions: char filters, tokenizers, token filters.

A token stream is an array column; positions are places in it. Filters that
remove tokens keep the gaps if they are asked for positions.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.folds import scan

WORD = r"[\p{L}\p{N}]+"
MAX_TOKEN = 255
#: The usual English stop list of search libraries.
ENGLISH_STOP = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
#: Usual stop lists of other languages, function words only.
FRENCH_STOP = """
    au aux avec c ce ceci cela ces cet cette d dans de des du elle en es est et eu eux il ils j je l la le les leur leurs lui m ma mais me
    même mes moi mon n ne nos notre nous on ont ou où par pas pour qu que quel quelle quels quelles qui s sa sans se ses si son sont soi
    sur t ta te tes toi ton tu un une vos votre vous y à été être
""".split()
GERMAN_STOP = """
    aber als am an auch auf aus bei bin bis bist da damit dann das dass dein deine dem den der des dessen die dies diese dieser dieses dir doch
    dort du durch ein eine einem einen einer eines er es euer eure für hat hatte hier hin hinter ich ihm ihn ihr ihre im in indem ins ist ja
    jede jeder jedes jener jenes jetzt kann kein keine können mein meine mich mir mit muss musste nach nicht nichts noch nun nur ob oder ohne
    sehr sein seine selbst sich sie sind so solche soll sollte sondern um und uns unser unter viel vom von vor war waren warum was weil weiter
    welche wenn wer werde werden wie wieder will wir wird wirst wo wollen würde zu zum zur zwar zwischen über
""".split()
SPANISH_STOP = """
    a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era es esa esas
    ese eso esos esta estas este esto estos está estoy fue ha hay la las le les lo los me mi mis mucho muchos muy más ni no nos nosotros nuestra
    nuestro o os otra otras otro otros para pero poco por porque que quien quienes qué se ser si sin sobre son su sus sí también tanto te tiene
    tu tus un una uno unos y ya yo él
""".split()


def standard(text: Column, stop: Iterable[str] = ()) -> Column:
    """Lower-cased runs of letters and digits, without stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return without(tokens, stop) if (stop := list(stop)) else tokens


def whitespace(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def keyword(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(text))


def pattern(text: Column, regexp: str, group: int = -1) -> Column:
    """Splits at a pattern, or takes one of its groups."""
    if group < 0:
        return F.filter(F.split(text, regexp), lambda t: t != "")
    return F.regexp_extract_all(text, F.lit(regexp), F.lit(group))


def lower(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(t))


def without(tokens: Column, stop: Iterable[str]) -> Column:
    stop = list(stop)
    return F.filter(tokens, lambda t: ~t.isin(stop))


def with_positions(tokens: Column, stop: Iterable[str] = ()) -> Column:
    """``array<struct<position, token>>``; removed stop words leave holes."""
    stop = list(stop)
    all_ = F.transform(tokens, lambda t, i: F.struct(i.alias("position"), t.alias("token")))
    return F.filter(all_, lambda x: ~x["token"].isin(stop)) if stop else all_


def with_offsets(text: Column, regexp: str = WORD) -> Column:
    """``array<struct<token, start, end>>`` in code points, ends exclusive."""
    gaps = F.transform(F.split(text, regexp, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(regexp), F.lit(0))
    # one gap more than tokens: what lies after the last
    steps = F.filter(F.zip_with(gaps, found, lambda g, t: F.struct(g.alias("gap"), t.alias("token"))), lambda x: x["token"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["gap"]
        e = s + F.length(x["token"])
        return e, F.array(F.struct(x["token"].alias("token"), s.alias("start"), e.alias("end")))

    return F.when(text.isNotNull(), scan(steps, F.lit(0), step, "struct<token:string,start:int,end:int>"))


def possessive(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.regexp_replace(t, "['’][sS]$", ""))


def minimal_english_stem(tokens: Column) -> Column:
    """Plurals only: -ies to -y, -es and -s dropped where that is safe."""

    def stem(t: Column) -> Column:
        return (
            F.when((F.length(t) < 3) | ~t.endswith("s") | t.rlike("(us|ss)$"), t)
            .when(t.rlike("[^ae]ies$"), F.regexp_replace(t, "ies$", "y"))
            .when(t.rlike("[^aeo]es$") | t.rlike("oes$"), F.regexp_replace(t, "s$", ""))
            .otherwise(F.regexp_replace(t, "s$", ""))
        )

    return F.transform(tokens, stem)


def light_stem(tokens: Column, language: str) -> Column:
    """Drops the commonest endings of a language: a light stemmer as one expression."""
    endings = {
        "en": r"(?:ations?|ingly|edly|ings?|ness|ments?|ers?|ed|ly|es|s)$",
        "fr": r"(?:issements?|ements?|ations?|euses?|eaux|aux|eux|ées?|és?|es|er|s|e)$",
        "de": r"(?:ungen|heiten|keiten|ung|heit|keit|lich|ern|em|en|er|es|e|n|s)$",
        "es": r"(?:amientos?|aciones|ación|mente|idades|idad|es|os|as|o|a|s)$",
    }[language]
    return F.transform(tokens, lambda t: F.when(F.length(t) > 5, F.regexp_replace(t, endings, "")).otherwise(t))


def fold_accents(tokens: Column) -> Column:
    """Western letters without their marks."""
    return F.transform(tokens, lambda t: F.translate(t, "àâäáãéèêëíìîïóòôöõúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """Character n-grams of each token, by token, then size, then place."""

    def of(t: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: n <= F.length(t))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))))

    return F.flatten(F.transform(tokens, of))


def edge_ngrams(tokens: Column, low: int, high: int) -> Column:
    def of(t: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: n <= F.length(t))
        return F.transform(sizes, lambda n: F.substring(t, F.lit(1), n))

    return F.flatten(F.transform(tokens, of))


def shingles(tokens: Column, size: int = 2) -> Column:
    """Neighbouring tokens joined by spaces; the shifted arrays are made once, not once a place."""
    n = F.size(tokens)
    shifted = [F.slice(tokens, k + 1, F.greatest(n - size + 1, F.lit(0))).alias(f"s{k}") for k in range(size)]
    rows = F.filter(F.arrays_zip(*shifted), lambda x: x[f"s{size - 1}"].isNotNull())
    return F.transform(rows, lambda x: F.concat_ws(" ", *[x[f"s{k}"] for k in range(size)]))


def cjk_bigrams(text: Column) -> Column:
    """Overlapping pairs of ideographs and kana; other runs of letters and digits stay whole."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"), F.lit(0))

    def cut(t: Column) -> Column:
        cjk = t.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(cjk, pairs).otherwise(F.array(t))

    return F.flatten(F.transform(runs, cut))


def word_delimiter(tokens: Column) -> Column:
    """Cuts tokens at case changes, at changes between letters and digits, and at other signs."""
    cut = r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+"
    return F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(cut), F.lit(0))))


def synonyms(tokens: Column, rules: dict[str, str], replace: bool = True) -> Column:
    """Rewrites phrases: the longest rule first. Without ``replace`` the original words stay beside.

    Words are joined by a unit separator, so that rules match whole words.
    """
    sep = "\u001f"
    joined = F.concat(F.lit(sep), F.array_join(tokens, sep + sep), F.lit(sep))
    for phrase, to in sorted(rules.items(), key=lambda kv: -len(kv[0].split())):
        old = sep + (sep + sep).join(phrase.split()) + sep
        new = sep + (sep + sep).join(to.split()) + sep
        joined = F.replace(joined, F.lit(old), F.lit(new if replace else new + old))
    return F.filter(F.split(joined, sep), lambda t: t != "")


def map_chars(text: Column, rules: dict[str, str]) -> Column:
    for old, new in rules.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags; common entities resolved."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return map_chars(bare, {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&amp;": "&"})


def joined_values(values: Column, gap: str = " ") -> Column:
    """A multi-valued text as one stream."""
    return F.array_join(values, gap)


def map_terms(tokens: DataFrame, term_col: str, function, out: str = "term") -> DataFrame:
    """Applies a Python function to the *distinct* terms of a table and joins it back.

    For stemmers that no expression can say: the function sees each term once.
    """

    @F.pandas_udf("string")
    def apply(t: pd.Series) -> pd.Series:
        return t.map(function)

    terms = tokens.select(F.col(term_col).alias("__raw")).distinct().withColumn("__mapped", apply("__raw"))
    joined = tokens.join(terms, tokens[term_col] == F.col("__raw"), "left")
    return joined.withColumn(out, F.col("__mapped")).drop("__raw", "__mapped")
