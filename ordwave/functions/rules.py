"""Ordered rules over texts and option maps: classifiers, defaults, command lines, output names, clips."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let

# What a lower-case model path must hold, in order of precedence, and its family.
MODEL_FAMILIES = [
    (["abme_best"], "abme"), (["anytime"], "any_time"), (["anime", "sharp"], "v2"), (["anime", "smooth"], "v2"), (["anime"], "v6"), (["official", "2."], "v2"),
    (["official", "3."], "v3"), (["official", "v6"], "v6"), (["official", "4."], "v4"), (["official"], "v7"), (["xvfi"], "xvfi"),
]


def first_rule(text: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """The result of the first rule all of whose words the text holds; a null text has the default."""
    out = None
    for words, result in rules:
        holds = F.lit(True)
        for w in words:
            holds = holds & F.contains(text, F.lit(w))
        out = F.when(holds, result) if out is None else out.when(holds, result)
    return out.otherwise(default)


def model_family(path: Column) -> Column:
    return first_rule(F.lower(path), MODEL_FAMILIES, "v2")


def hdr_state(info: Column, transfer: Column, has_dynamic: Column, one_click: Column) -> Column:
    """How a stream's brightness is coded, from all its information as text, its transfer tag and whether it has dynamic metadata.

    States: dolby_vision, none, custom_hdr, hdr10, hdr10_plus, hlg. A stream without high range becomes
    hdr10 where one-click conversion is asked for, if it has a transfer tag. Words are looked for as
    substrings of the information, so a stream without mastering data is no hdr10.
    """
    has = lambda c, *words: F.coalesce(F.greatest(*[F.contains(c, F.lit(w)) for w in (*words, words[0])]), F.lit(False))
    mastered = has(F.lower(info), "mastering-display", "mastering display", "content light level metadata")
    wide = F.when(mastered & has_dynamic, "hdr10_plus").when(mastered, "hdr10").otherwise("custom_hdr")
    plain = F.when(one_click, "hdr10").otherwise("none")
    return F.when(has(info, "dv_profile", "DOVI"), "dolby_vision").when(transfer.isNull(), "none").when(has(transfer, "smpte2084", "bt2020"), wide).when(has(transfer, "arib-std-b67"), "hlg").otherwise(plain)


def with_defaults(options: Column, defaults: dict[str, str]) -> Column:
    """The map of options with defaults for names that it lacks; its own values win, also empty ones."""
    table = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(F.map_filter(table, lambda k, _: ~F.map_contains_key(options, k)), options)


def overridden(options: Column, by: Column) -> Column:
    """One map over another: values of `by` win."""
    return F.map_concat(F.map_filter(options, lambda k, _: ~F.map_contains_key(by, k)), by)


def non_empty(tags: Column) -> Column:
    """The entries of a map that have a value."""
    return F.map_filter(tags, lambda _, v: v.isNotNull() & (v != ""))


def command_options(text: Column) -> Column:
    """Options of a line of parts between '||': [(flag, value)] of the parts that begin with '-', with the part after them.

    A flag before another flag or the end has an empty value; a part that follows no flag has an
    empty flag. Of equal flags the last one counts. Escaped quotes lose their backslash.
    """
    clean = lambda x: F.regexp_replace(F.replace(F.replace(F.trim(x), F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')), r"^\\+|\\+$", "")
    flag = lambda x: F.startswith(x, F.lit("-"))

    def pairs(parts: Column) -> Column:
        def pair(x, i):
            after, before = F.get(parts, i + 1), F.get(parts, i - 1)
            return F.when(flag(x), F.struct(x.alias("flag"), F.when(after.isNull() | flag(after), "").otherwise(after).alias("value"))).when(before.isNull() | ~flag(before), F.struct(F.lit("").alias("flag"), x.alias("value")))

        return F.filter(F.transform(parts, pair), lambda p: p.isNotNull())

    def last_ones(found: Column) -> Column:
        return F.filter(found, lambda p, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda q: q["flag"] == p["flag"]))

    return let(F.transform(F.split(text, r"\|\|"), clean), lambda parts: let(pairs(parts), last_ones))


def output_name(stem: Column, tags: list[tuple[Column, Column]], extension: Column) -> Column:
    """The stem, each tag whose condition holds, in order, and the extension, with dots between."""
    return F.concat_ws(".", stem, *[F.when(holds, tag) for holds, tag in tags], extension)


def clip(begin: Column, end: Column, duration: Column) -> Column:
    """(begin, end) of the part to read, in seconds; null where there is none or it is inverted, and so everything is read.

    A missing begin is 0, a missing end the duration; with neither all is read.
    """
    a, z = F.coalesce(begin, F.lit(0.0)), F.coalesce(end, duration, F.lit(0.0))
    return F.when((begin.isNotNull() | end.isNotNull()) & (z > a), F.struct(a.alias("begin"), z.alias("end")))


def plan_options(requests: DataFrame, rules: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Each request with the options of the first rule (by priority) that fits it; a null key of a rule fits anything.

    rules has the keys, priority and options. A request looks up each combination of its keys and
    nulls but that of nulls alone, so rules are joined by equality whatever their number; the first of
    the rules that fit anything, a single row, stands beside all. Requests that no rule fits have null options.
    """
    wild = [F.struct(*[(F.col(k) if mask >> i & 1 else F.lit(None)).cast("string").alias(k) for i, k in enumerate(keys)]) for mask in range(1, 2 ** len(keys))]
    tried = requests.withColumn("__k", F.explode(F.array(*wild)))
    ready = rules.select(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]).alias("__r"), "priority", "options")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"__k.{k}").eqNullSafe(F.col(f"__r.{k}"))
    first = lambda name: F.struct(F.min("priority").alias("p"), F.min_by("options", "priority").alias("o")).alias(name)
    found = tried.join(ready, on).groupBy(id_col).agg(first("__own"))
    anything = ready.where(reduce(and_, [F.col(f"__r.{k}").isNull() for k in keys])).agg(first("__any"))
    beside = requests.join(found, id_col, "left").join(F.broadcast(anything))  # one row
    own = F.col("__own.p").isNotNull() & ~F.coalesce(F.col("__any.p") < F.col("__own.p"), F.lit(False))
    return beside.withColumn("options", F.when(own, F.col("__own.o")).otherwise(F.col("__any.o"))).drop("__own", "__any")


def progress(done: Column, total: Column, least: float = 0.8) -> tuple[Column, Column]:
    """The share that is done, and whether it is less than it should be at the end."""
    share = done / F.nullif(total, F.lit(0))
    return share, F.coalesce(share < least, F.lit(True))
