"""hreflang and news language codes."""

from __future__ import annotations

from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 639-1 languages that an hreflang may name. Fixed values of the check.
LANGUAGES = """
aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy
da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz
ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv
mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu
rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty
ug uk ur uz ve vi vo wa wo xh yi yo za zh zu
""".split()


@cache
def regions() -> tuple[str, ...]:
    """ISO 3166-1 regions as the JVM knows them, and Kosovo's XK."""
    jvm = SparkContext.getOrCreate()._jvm  # threads have no active session of their own
    return tuple(sorted({*jvm.java.util.Locale.getISOCountries(), "XK"}))


def quoted(v: Column) -> Column:
    """v in double quotes, as messages show values."""
    v = F.regexp_replace(v, r'(["\\])', r"\\$1")
    for char, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        v = F.replace(v, F.lit(char), F.lit(shown))
    return F.concat(F.lit('"'), v, F.lit('"'))


def hreflang_error(tag: Column) -> Column:
    """What is wrong with an hreflang value; null if it is x-default or language[-Script][-REGION]."""
    parts = F.split(tag, "-")
    script = (F.size(parts) > 1) & F.get(parts, F.lit(1)).rlike("^[A-Za-z]{4}$")
    rest = F.slice(parts, F.when(script, 3).otherwise(2), 1 << 20)
    region = F.get(rest, F.lit(0))
    message = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    known = region.rlike("^[0-9]{3}$") | F.upper(region).isin(*regions())
    q = quoted(tag)
    return (
        F.when(F.lower(tag) == "x-default", None)
        .when(tag == "", "empty hreflang")
        .when(F.contains(tag, F.lit("_")), message(q, " uses _ instead of -"))
        .when(~F.lower(F.get(parts, F.lit(0))).isin(*LANGUAGES), message(q, ": ", quoted(F.get(parts, F.lit(0))), " is not an ISO 639-1 language code"))
        .when((F.size(rest) == 0) | (F.size(rest) == 1) & known, None)
        .when(F.size(rest) > 1, message(q, " has too many subtags"))
        .when(F.upper(region) == "UK", message(q, ": the region code of the United Kingdom is GB"))
        .otherwise(message(q, ": ", quoted(region), " is not an ISO 3166-1 region code"))
    )


def news_language(v: Column) -> Column:
    """zh-cn, zh-tw, three letters, or a lower-case ISO 639-1 code."""
    low = F.lower(v)
    return low.isin("zh-cn", "zh-tw") | low.rlike("^[a-z]{3}$") | v.isin(*LANGUAGES)
