"""Pages over HTTP, and lists of sources.

One task serves a host, one request after the other, so the pause between requests of a host holds without shared state;
hosts are spread over the cluster. A request that fails is tried again, after pauses that double. What can't be had is a row
with an error, so that a job never ends on one page; a task that is run again asks for its pages again."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as u

FETCHED = "url string, status int, content_type string, html string, error string"
AGENT = "sheaf/1.0"


def _get(address: str, timeout: float, retries: int, pause: float, agent: str) -> tuple:
    error = None
    for n in range(retries + 1):
        if n:
            time.sleep(pause * 2 ** (n - 1))
        try:
            with urllib.request.urlopen(urllib.request.Request(address, headers={"User-Agent": agent}), timeout=timeout) as r:
                kind = r.headers.get_content_type()
                text = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
                return address, r.status, kind, text, None
        except urllib.error.HTTPError as e:
            if e.code < 500:  # asking again won't help
                return address, e.code, None, None, str(e)
            error = (address, e.code, None, None, str(e))
        except (OSError, ValueError) as e:
            error = (address, None, None, None, str(e))
    return error


def fetch(urls: DataFrame, timeout: float = 30, retries: int = 3, delay: float = 5, pause: float = 1, agent: str = AGENT) -> DataFrame:
    """urls (url) -> (url, status, content_type, html, error); each url once."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for pdf in batches:
            rows = []
            for address, host in zip(pdf["url"], pdf["host"], strict=True):
                wait = last.get(host, -delay) + delay - time.monotonic()
                if host in last and wait > 0:
                    time.sleep(wait)
                rows.append(_get(address, timeout, retries, pause, agent))
                last[host] = time.monotonic()
            out = pd.DataFrame(rows, columns=["url", "status", "content_type", "html", "error"])
            yield out.astype({"status": "Int64"})

    asked = urls.select("url").filter(u.is_valid(F.col("url"))).distinct().withColumn("host", u.host(F.col("url")))
    return asked.repartition("host").sortWithinPartitions("host", "url").mapInPandas(of, FETCHED)


def combined(spark: SparkSession, lists: Mapping[str, Iterable[str]], names: Iterable[str] | None = None) -> DataFrame:
    """(position, url, list): the urls of the named lists, or of all, in order, each where it comes first."""
    seen: dict[str, str] = {}
    for name in names if names is not None else lists:
        for address in lists.get(name, ()):
            seen.setdefault(address.strip(), name)
    return spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(x for x in seen.items() if x[0])], "position int, url string, list string")
