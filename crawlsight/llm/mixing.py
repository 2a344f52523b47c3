"""Mixing of sources to target weights, in DataFrame functions only.

A budget of tokens goes down a tree of domains, languages and sources. Children share their parent's budget by weight;
what a child lacks (its documents times the epochs allowed) goes to its siblings first, and what they cannot take to the
parent's siblings, since no node gets more than its documents hold. A leaf reads whole epochs of its documents and then
the prefix of one more, in an order seeded by epoch. The prefix is found by sums over 4096 parts of that order, narrowed
down 16 at a time, so only the documents of the one part that holds its end are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.llm.common import WORD, written
from crawlsight.llm.line_dedup import place_columns

LEVELS = ("domain", "lang", "source")
#: Sources in four domains by their number; a source without a number is in the last.
DOMAIN = "CASE coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint), -1) % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'forums' END"
#: Whole numbers; a child without one weighs 1.
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "forums": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2, "src1": 3}}
SEED = 17
#: Of the tokens that the documents hold once, in hundredths.
BUDGET_PERCENT = 50
MAX_EPOCHS = 4
#: Hexadecimal digits of a document's place in an epoch that tell its part: 4096 parts.
DIGITS = 3
#: Leaves up to which their plan (some 100 bytes each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_LEAVES = 20_000


def leaf_columns(docs: DataFrame, domain: str = DOMAIN) -> list[Column]:
    """did, tk, domain, lang, source (a null is the child '') and tokens (words) of each document."""
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return [*place_columns(docs), F.coalesce(F.expr(domain), F.lit("")).alias("domain"), *named, tokens.alias("tokens")]


def weight(level: str, weights: dict) -> Column:
    known = [F.lit(x) for pair in weights.get(level, {}).items() for x in pair]
    return (F.coalesce(F.element_at(F.create_map(*known), F.col(level)), F.lit(1)) if known else F.lit(1)).cast("long")


def shared(nodes: DataFrame, parent: list[str], level: str, weights: dict) -> DataFrame:
    """nodes (parent..., level, cap, budget of the parent) with the budget replaced by the node's own part.

    Sorted by cap / weight, a node is filled if its weighted part of what is left after those before it covers its cap;
    the others share the rest by weight, odd tokens going to the first of them.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), level)
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    x = nodes.withColumn("w", weight(level, weights))
    x = x.withColumn("rem", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(onwards))
    x = x.withColumn("full", wide("cap") * wide("ws") <= wide("rem") * wide("w"))
    open_ = lambda c: F.when(~F.col("full"), F.col(c))
    x = x.withColumn("rem", F.max(open_("rem")).over(by)).withColumn("ws", F.max(open_("ws")).over(by))
    x = x.withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(cast(w AS decimal(19,0)) * cast(rem AS decimal(19,0)) div ws AS bigint)")))
    odd = F.col("rem") - F.sum(open_("part")).over(by)
    place = F.sum(F.when(F.col("full"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("odd", odd).withColumn("place", place).withColumn("budget", F.col("part") + F.when(~F.col("full") & (F.col("place") <= F.col("odd")), 1).otherwise(0)).drop("w", "rem", "ws", "full", "part", "odd", "place")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict, max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, once) with the tokens each is to give. budget: an expression over sum(once)."""
    leaves = leaves.withColumn("cap", F.col("once") * max_epochs)
    parents = leaves.groupBy().agg(F.sum("once").alias("once"), F.sum("cap").alias("cap")).select(F.least(budget, F.col("cap")).alias("budget"))
    for depth, level in enumerate(LEVELS):
        parent, own = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*own).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(parents.select(*parent, "budget"), parent) if parent else nodes.crossJoin(F.broadcast(parents))
        parents = shared(nodes, parent, level, weights)
    return leaves.join(parents.select(*LEVELS, "budget"), list(LEVELS))


def small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan


def in_order(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows (LEVELS, did, tk) with their leaf's plan and their place in its last epoch's order: h, and its part."""
    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), "copies", "did", "tk"))
    return rows.join(plan, list(LEVELS)).withColumn("h", seeded).withColumn("part", F.substring("h", 1, DIGITS))


def planned(slim: DataFrame, weights: dict, budget_percent: int, max_epochs: int, seed: int) -> DataFrame:
    """A row for each leaf: whole epochs (copies), the tokens of one more (rest), the part where they end, what is before it."""
    leaves = written(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("once")), "mix-leaves")
    budget = F.expr(f"once * {budget_percent} div 100")
    given = leaf_budgets(leaves, budget, weights, max_epochs)
    copies = F.when(F.col("once") > 0, F.expr("budget div once")).otherwise(F.lit(0)).cast("long")
    plan = written(given.withColumn("copies", copies).withColumn("rest", F.col("budget") - F.col("copies") * F.col("once")).select(*LEVELS, "copies", "rest"), "mix-plan")
    parts = written(in_order(slim, small(plan), seed).groupBy(*LEVELS, "part").agg(F.sum("tokens").alias("held")), "mix-parts")
    ends = plan.where("rest > 0").select(*LEVELS, "rest", F.lit("").alias("end_part"), F.lit(0).cast("long").alias("before"))
    for digits in range(1, DIGITS + 1):
        ends = narrowed(parts, small(ends), digits)
    return written(plan.join(ends.drop("rest"), list(LEVELS), "left"), "mix-ends")


def narrowed(parts: DataFrame, ends: DataFrame, digits: int) -> DataFrame:
    """ends (LEVELS, rest, end_part, before) by one digit more: of the 16 parts below a leaf's end_part the one with its end."""
    below = parts.join(ends, list(LEVELS)).where(F.startswith("part", "end_part"))
    sums = below.groupBy(*LEVELS, "rest", "before", F.substring("part", 1, digits).alias("part")).agg(F.sum("held").alias("held"))
    upto = F.col("before") + F.sum("held").over(Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    found = sums.withColumn("upto", upto).where("upto >= rest AND upto - held < rest")
    return found.select(*LEVELS, "rest", F.col("part").alias("end_part"), (F.col("upto") - F.col("held")).alias("before"))


def taken(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows (LEVELS, did, tk, tokens, others) with copies and prefix_tokens, those of which nothing is taken left out."""
    placed = in_order(rows, small(plan), seed)
    prefix = F.when(F.col("part") < F.col("end_part"), F.col("tokens")).otherwise(F.lit(0)).cast("long")
    plain = placed.where("end_part IS NULL OR part <> end_part").withColumn("prefix_tokens", prefix)
    order = Window.partitionBy(*LEVELS).orderBy("h", "did", "tk").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("part = end_part")
    start = F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))
    edge = edge.withColumn("prefix_tokens", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - start)).cast("long"))
    return plain.unionByName(edge).where("copies > 0 OR prefix_tokens > 0").drop("h", "part", "end_part", "before", "rest")


def mix(docs: DataFrame, weights: dict = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: str = DOMAIN) -> DataFrame:
    """What is taken of docs (doc_id, text, lang, source): doc_id, domain, lang, source, tokens, copies, prefix_tokens.

    copies: whole epochs that hold the document; prefix_tokens: its tokens in the prefix of one more epoch, the last
    document there being cut. Documents of which nothing is taken have no row; those without words never have one but
    with whole epochs. The parts add up to the budget, or to all tokens times max_epochs if that is less. Null texts
    hold no tokens, null languages and sources are children named ''; repeated rows count each; other columns are
    ignored; an empty table gives no rows.
    """
    slim = written(docs.select("doc_id", *leaf_columns(docs, domain)), "mix-slim")
    plan = planned(slim, weights, budget_percent, max_epochs, seed)
    return taken(slim, plan, seed).select("doc_id", *LEVELS, "tokens", "copies", "prefix_tokens")


def mixed_texts(docs: DataFrame, weights: dict = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: str = DOMAIN) -> DataFrame:
    """docs as the mix holds them, in the columns of docs: a row for each whole copy, and one for the prefix of one more.

    n_chars, if there, is that of the text kept. Cases are those of mix().
    """
    columns = leaf_columns(docs, domain)
    plan = planned(written(docs.select(*columns), "mix-slim"), weights, budget_percent, max_epochs, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)
    cut = F.expr(r"array_join(slice(split(row.text, '(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])'), 1, cast(part_tokens AS int)), '')")
    takes = F.expr("explode(concat(array_repeat(tokens, cast(copies AS int)), if(prefix_tokens > 0, array(prefix_tokens), cast(array() AS array<bigint>))))")
    got = taken(rows, plan, seed).withColumn("part_tokens", takes)
    text = F.when(F.col("part_tokens") < F.col("tokens"), cut).otherwise(F.col("row.text"))
    got = got.withColumn("text_taken", text)
    own = {"text": F.col("text_taken"), "n_chars": F.char_length("text_taken").cast("long")}
    return got.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


SQL = f"""
WITH slim AS (
  SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS did, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS tk,
    CASE coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT), -1) % 4
      WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'forums' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(tokens)::HUGEINT AS once, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS cap,
    CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS wd,
    CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS wl,
    CASE source WHEN 'src0' THEN 2 WHEN 'src1' THEN 3 ELSE 1 END AS ws
  FROM slim GROUP BY domain, lang, source),
root AS (SELECT least((sum(once) * {BUDGET_PERCENT}) // 100, sum(cap)) AS budget FROM leaves),
""" + "".join(
    f"""
{name}_a AS (
  SELECT n.*, budget - coalesce(sum(cap) OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
    sum(w) OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum,
    row_number() OVER (PARTITION BY {by} ORDER BY cap::DOUBLE / w, {level}) AS k
  FROM (SELECT {keys}, sum(cap) AS cap, any_value({w}) AS w FROM leaves GROUP BY {keys}) n JOIN {parent} p ON {on}),
{name}_b AS (
  SELECT {keys}, cap, w, k, NOT (cap * wsum <= rem * w) AS open,
    max(CASE WHEN NOT (cap * wsum <= rem * w) THEN rem END) OVER (PARTITION BY {by}) AS rem,
    max(CASE WHEN NOT (cap * wsum <= rem * w) THEN wsum END) OVER (PARTITION BY {by}) AS wsum
  FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN open THEN (w * rem) // wsum ELSE cap END AS part FROM {name}_b),
{name} AS (
  SELECT {keys}, part + CASE WHEN open AND sum(open::INT) OVER (PARTITION BY {by} ORDER BY k)
      <= rem - sum(CASE WHEN open THEN part END) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END AS budget
  FROM {name}_c),"""
    for name, keys, by, level, w, parent, on in (
        ("domains", "domain", "0", "domain", "wd", "root", "true"),
        ("langs", "domain, lang", "domain", "lang", "wl", "(SELECT domain AS pd, budget FROM domains)", "pd = domain"),
        ("sources", "domain, lang, source", "domain, lang", "source", "ws", "(SELECT domain AS pd, lang AS pl, budget FROM langs)", "pd = domain AND pl = lang"),
    )
) + """
plan AS (
  SELECT l.domain, l.lang, l.source, CASE WHEN once > 0 THEN budget // once ELSE 0 END::BIGINT AS copies,
    (budget - CASE WHEN once > 0 THEN budget // once ELSE 0 END * once)::BIGINT AS rest
  FROM leaves l JOIN sources s ON s.domain = l.domain AND s.lang = l.lang AND s.source = l.source),
placed AS (
  SELECT d.*, copies, rest, coalesce(sum(tokens) OVER (PARTITION BY d.domain, d.lang, d.source
      ORDER BY md5(concat_ws(':', '17', copies, did, tk)), did, tk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM slim d JOIN plan p ON p.domain = d.domain AND p.lang = d.lang AND p.source = d.source),
taken AS (SELECT *, greatest(0, least(tokens, rest - start))::BIGINT AS prefix_tokens FROM placed)
SELECT doc_id, domain, lang, source, tokens, copies, prefix_tokens FROM taken WHERE copies > 0 OR prefix_tokens > 0
"""
