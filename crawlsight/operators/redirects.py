"""Redirect chains: hops are joined one after another, for all URLs at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import urls
from crawlsight.operators.catalogue import each, found, issue, one_of

STATE = "site_id", "url", "prev", "next", "chain", "seen", "downgrades"
HOPS = "array<struct<url: string, status: int>>"


def _secure_to_plain(a: Column, b: Column) -> Column:
    return F.lower(a).startswith("https://") & F.lower(b).startswith("http://")


def chains(starts: DataFrame, hops: DataFrame, max_redirects: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(site_id, url, redirect_chain, end, last, hop, final_status, downgrades) of starts (site_id, url, redirect_to).

    hops: (site_id, request_url, status, location), the answer to each address, one row each. end: loop, limit or
    answer. Each round looks up the next hop of all open chains by one join; keep() writes what a round leaves and reads
    it back. There are max_redirects + 1 rounds at most, and none when no chain is open.
    """
    # The status of the hop stands beside the location, so that a round is one lookup.
    answers = hops.select("site_id", F.col("request_url").alias("next"), F.col("status").alias("hop_status"), F.coalesce("location", F.lit("")).alias("hop_location"))
    open_ = starts.select(
        "site_id", "url", F.col("url").alias("prev"), F.col("redirect_to").alias("next"), F.array().cast(HOPS).alias("chain"),
        F.array(urls.normalize(F.col("url"))).alias("seen"), F.array().cast("array<string>").alias("downgrades"),
    )
    ended = []
    for hop in range(1, max_redirects + 2):
        down = F.when(_secure_to_plain(F.col("prev"), F.col("next")), F.array(F.concat("prev", F.lit(" -> "), "next"))).otherwise(F.array().cast("array<string>"))
        norm = urls.normalize(F.col("next"))
        x = open_.withColumn("downgrades", F.concat("downgrades", down)).withColumn("norm", norm)
        x = x.withColumn("end", F.when(F.array_contains("seen", F.col("norm")), "loop").when(F.lit(hop > max_redirects), "limit"))
        x = x.withColumn("seen", F.array_append("seen", F.col("norm"))).drop("norm").join(answers, ["site_id", "next"], "left")
        status = F.coalesce("hop_status", F.lit(0))
        goes_on = F.col("end").isNull() & status.between(300, 399) & (F.coalesce("hop_location", F.lit("")) != "")
        chain = F.when(F.col("end").isNull(), F.array_append("chain", F.struct(F.col("next").alias("url"), status.alias("status")))).otherwise(F.col("chain"))
        end = F.when(F.col("end").isNull() & ~goes_on, "answer").otherwise(F.col("end"))
        x = keep(x.withColumn("hop_status", status).withColumn("chain", chain).withColumn("end", end), f"hop-{hop}")
        ended.append(x.where("end IS NOT NULL").withColumn("hop", F.lit(hop)))
        open_ = x.where("end IS NULL").select("site_id", "url", F.col("next").alias("prev"), F.col("hop_location").alias("next"), "chain", "seen", "downgrades")
        if open_.isEmpty():
            break
    done = ended[0]
    for e in ended[1:]:
        done = done.unionByName(e)
    final = F.when(F.col("end") == "answer", F.col("hop_status"))
    return done.select("site_id", "url", F.col("chain").alias("redirect_chain"), "end", F.col("next").alias("last"), "hop", final.alias("final_status"), "downgrades")


def chain_issues(max_redirects: int) -> Column:
    """Issues of a row of chains(), in order."""
    path = F.array_join(F.concat(F.array("url"), F.transform("redirect_chain", lambda h: h["url"])), " -> ")
    end, status = F.col("end"), F.col("final_status")
    label = F.when(status == 0, "000").otherwise(status.cast("string"))
    return found(
        each(F.col("downgrades"), lambda d: issue("URL_REDIRECT_DOWNGRADE", F.lit(True), d)),
        one_of(
            issue("URL_REDIRECT_LOOP", end == "loop", "back to ", F.col("last"), " after ", F.col("hop"), " hops"),
            issue("URL_REDIRECT_BROKEN", end == "limit", f"more than {max_redirects} hops"),
            issue("URL_REDIRECT_CHAIN", (end == "answer") & (F.col("hop") > 1), F.col("hop"), " hops: ", path),
            issue("URL_REDIRECT_BROKEN", (end == "answer") & (status != 200), "ends on ", F.col("last"), " (", label, ")"),
        ),
    )
