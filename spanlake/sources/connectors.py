"""What stands between the engine and remote models: which endpoints are public, what a probe says, which parts fit, and calls over work orders.

Nothing here calls anything by itself: ``answered`` is handed the function that does.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import TRANSIENT

# Endings of names that never are public; heights that a video segment is tried at, from best to least.
PRIVATE = ["localhost", ".localhost", ".local", ".internal"]


def endpoint_host(url: Column) -> Column:
    """The host of an https URL, lower-case; null for any other."""
    host = F.lower(F.regexp_extract(F.trim(url), r"(?i)^https://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^\[|\]$", ""), F.lit(""))


def is_public(address: Column) -> Column:
    """Whether an address is one of the public internet; false if it is no address."""

    @F.pandas_udf("boolean")
    def public(addresses: pd.Series) -> pd.Series:
        def told(x) -> bool:
            try:
                return ipaddress.ip_address(str(x).split("%")[0]).is_global
            except ValueError:
                return False

        return addresses.map(told)

    return public(address)


def endpoint_verdicts(endpoints: DataFrame, addresses: DataFrame) -> DataFrame:
    """id, verdict of (id, url): ok, not_https, private_name, unresolved or private_address; addresses: host, address, as resolved by whoever asks.

    Every address of a host must be public.
    """
    rows = endpoints.select("id", endpoint_host(F.col("url")).alias("host"))
    open_ = addresses.groupBy("host").agg(F.min(is_public(F.col("address")).cast("int")).alias("public"))
    named = F.col("host").isin(PRIVATE[0])
    for ending in PRIVATE[1:]:
        named = named | F.col("host").endswith(ending)
    verdict = F.when(F.col("host").isNull(), "not_https").when(named, "private_name").when(F.col("public").isNull(), "unresolved").when(F.col("public") == 0, "private_address").otherwise("ok")
    return rows.join(open_, "host", "left").select("id", verdict.alias("verdict"))


def probe_report(probes: DataFrame) -> DataFrame:
    """id, duration_ms, has_audio, subtitles of a probe's JSON (id, report); null and false where it says nothing."""
    duration = F.get_json_object("report", "$.format.duration").try_cast("double")
    kinds = F.from_json(F.get_json_object("report", "$.streams[*].codec_type"), "array<string>")
    one = F.array(F.get_json_object("report", "$.streams[0].codec_type"))
    kinds = F.coalesce(kinds, F.array_compact(one))  # a path that meets one value only gives it bare
    return probes.select("id", F.rint(duration * 1000).cast("long").alias("duration_ms"), F.coalesce(F.array_contains(kinds, "audio"), F.lit(False)).alias("has_audio"), F.size(F.filter(kinds, lambda k: k == "subtitle")).cast("long").alias("subtitles"))


def subtitle_streams(probes: DataFrame) -> DataFrame:
    """ep, index, language, title, forced: the subtitle streams that probes (id, report) list."""
    streams = F.from_json(F.get_json_object("report", "$.streams"), "array<struct<index:long,codec_type:string,tags:struct<language:string,title:string>,disposition:struct<forced:int>>>")
    rows = probes.select(F.col("id").alias("ep"), F.explode(streams).alias("s")).filter("s.codec_type = 'subtitle'")
    return rows.select("ep", "s.index", "s.tags.language", "s.tags.title", "s.disposition.forced")


def best_fit(sizes: DataFrame, budget: int) -> DataFrame:
    """id, rung: of encodings (id, rung, bytes) in order of preference the first within the budget; null if none is."""
    fits = sizes.groupBy("id").agg(F.min(F.when(F.col("bytes") <= budget, F.col("rung"))).alias("rung"))
    return fits.select("id", "rung")


def answered(orders: DataFrame, call: Callable[[dict], tuple[str, str | None]], attempts: int = 3) -> DataFrame:
    """ep, part, state, payload, tries: each work order answered by ``call``, which returns (kind, payload), kind being ok or a failure.

    A failure that may pass is tried again; one order's failure stops no other. Orders are dealt to tasks, so calls run side by side.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for order in batch.to_dict("records"):
                kind, payload, tries = "empty", None, 0
                while tries < attempts and kind in TRANSIENT:
                    kind, payload = call(order)
                    tries += 1
                out.append((order["ep"], order["part"], kind, payload if kind == "ok" else None, tries))
            yield pd.DataFrame(out, columns=["ep", "part", "state", "payload", "tries"])

    return orders.mapInPandas(run, "ep long, part long, state string, payload string, tries int")
