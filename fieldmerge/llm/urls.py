"""URL filters: rules of hosts and paths first, and for the rest a logistic regression on hashed character n-grams.

Features of a URL are the counts of 3- to 5-character stretches of "^host$" and of "^path$" (UTF-8 bytes), hashed to `buckets`
places for either, divided by the square root of their number. The weights come from a small labelled table, at most `max_rows`
rows of it; they are fitted in the space of the rows (Newton steps on a kernel matrix of rows), so training is exact and its cost
does not depend on `buckets`. The weights are one array of fixed size, which goes to every task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmerge.llm.common import LOWER, UPPER, over_batches

GRAMS = (3, 4, 5)
BUCKETS = 1 << 16

#: (host, path, verdict) of the query's rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: The small labelled table: hosts and paths of sites that a corpus does not want, and of others.
UNWANTED = """
https://casino-royal.example/slots  http://www.online-casino.test/en/1  https://casino777.example.net/win  http://lucky-casino-games.example/de/20
https://m.sports-bets.example/odds  http://bets-now.test/en/33.html  https://www.best-bets.example.com/fr/4  http://freebets24.example/join
https://ads-server.example/click?id=1  http://ads.banner-exchange.test/en/5  https://www.ads-network.example.com/77  http://my-ads.example.net/track
https://tracker-pixel.example/i.gif  http://click-track.test/en/8.html  https://track-visits.example.com/de/12  http://www.ad-tracking.example/fr/9
https://spam-links.example/buy  http://www.spam-blast.test/en/17  https://link-farm.example.com/es/3  http://content-farm.test/en/41/
https://cheap-pills.example/order  http://win-prize.example.net/claim  https://free-win.test/en/2  http://winner-bonus.example.com/de/6
https://poker-win.example/tables  http://xxx-cams.example.test/live  https://adult-video.example/en/1  http://free-porn.test/watch
https://adult-chat.example.com/en/7  http://www.adults-only.test/fr/61  https://xxx-clips.example.net/de/18  http://m.adult-dates.test/en/4
https://jackpot-slots.example.com/en/90  http://payday-loans.test/apply  https://free-money.example.net/fr/11  http://seo-farm.example.com/en/52
"""
WANTED = """
https://www.garden-society.example/roses  http://library.townhall.test/en/1  https://blog.history-notes.example.net/fr/12  http://m.cooking-home.example/de/20
https://math.university.example/notes  http://news-daily.test/en/33.html  https://www.river-museum.example.com/fr/4  http://forum.linux-help.example/join
https://docs.library-code.example/api?id=1  http://weather.coast.test/en/5  https://www.thornton.example.com/77  http://my-recipes.example.net/list
https://therapy-center.example/i.html  http://northern-trains.test/en/8.html  https://stations.example.com/de/12  http://www.nationstates.example/fr/9
https://open-maps.example/tiles  http://www.translation-club.test/en/17  https://blog.thenthe.example.com/es/3  http://teachers.test/en/41/
https://book-review.example/order  http://m.ontheroad.example.net/page  https://orchestra.test/en/2  http://standards.example.com/de/6
https://chess-club.example/tables  http://handbook.example.test/live  https://film-archive.example/en/1  http://birdwatch.test/watch
https://bakery-school.example.com/en/90  http://tax-office.test/apply  https://www.mountain-hut.example.net/fr/11  http://thesis.example.com/en/52
https://evening-school.example.com/en/7  http://www.parents-forum.test/fr/61  https://x-ray-clinic.example.net/de/18  http://m.ambulance.test/en/4
https://blog.arthing.example.org/en/8343?utm_source=feed  http://m.thinsh.example.net/fr/4512?page=2  https://www.ingover.example.com/de/299.html  http://eranre.example.org/en/104#top
https://tentions.example.net/en/212/  http://blog.heston.example.com/es/661  https://m.edable.example.org/fr/6886#top  http://www.andthe.example.net/de/273
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the small table of the two lists above, label 1 for the unwanted ones."""
    rows = [(url, label) for text, label in ((UNWANTED, 1), (WANTED, 0)) for url in text.split()]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ? or # or the end, A-Z lower-cased; null or without ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null: its host is the URL's or a parent domain of it, its path begins the URL's.

    The longest is that of most characters, then of the longest host, then the one that blocks.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    fits = [(F.endswith(F.concat(F.lit("."), host), F.lit("." + h)) & F.startswith(path, F.lit(p)), h + p, v) for h, p, v in order]
    told = [F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))) for test, rule, verdict in fits]
    return F.coalesce(*told) if told else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(column: pa.Array, seed: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram of ^text$, n-grams of a row together."""
    texts = pc.binary_join_element_wise("^", column, "$", "").cast(pa.binary())
    raw = b"".join(texts.to_pylist())
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes from here to the end of the text
    rows, places = [], []
    for n in GRAMS:
        here = np.flatnonzero(left >= n)
        h = np.full(len(here), seed * 8 + n, np.uint64)
        for k in range(n):
            h = (h ^ data[here + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        rows.append(row[here])
        places.append((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % buckets)
    return np.concatenate(rows), np.concatenate(places)


def _features(host: pa.Array, path: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, 1 / sqrt(number of the row's features)): a URL's features, those of the path beyond those of the host."""
    a, b = _grams(host, 1, buckets), _grams(path, 2, buckets)
    row, place = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + buckets])
    return row, place, 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(host))))


def fit(host: pa.Array, path: pa.Array, labels: np.ndarray, l2: float, buckets: int) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise log loss plus l2 / 2 times the squared weights; classes weigh the same.

    Without rows of both classes the weights are zero and the bias is the side that is there (block from 0 on; no rows: allow).
    """
    weights, n = np.zeros(2 * buckets), len(labels)
    if n == 0 or labels.min() == labels.max():
        return weights, 1.0 if n and labels[0] else -1.0
    row, place, scale = _features(host, path, buckets)
    used, place = np.unique(place, return_inverse=True)
    x = np.zeros((n, len(used)))
    np.add.at(x, (row, place), scale[row])
    kernel = x @ x.T + 1.0  # the bias is a feature of every row
    mass = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum())) * n
    alpha = np.zeros(n)
    for _ in range(50):
        p = 1 / (1 + np.exp(-kernel @ alpha))
        gradient = mass * (p - labels) + l2 * alpha
        step = np.linalg.solve((mass * p * (1 - p))[:, None] * kernel + l2 * np.eye(n), gradient)
        alpha -= step
        if np.abs(step).max() < 1e-10:
            break
    weights[used] = x.T @ alpha
    return weights, float(alpha.sum())


def train(labelled: DataFrame, l2: float = 0.1, buckets: int = BUCKETS, max_rows: int = 2_000) -> tuple[np.ndarray, float]:
    """fit() on at most max_rows rows of (url, label), those with the smallest hashes of the URL; label 1: block.

    Rows with a null label or a URL without host are left out; rows that repeat count each; order does not matter.
    """
    told = labelled.where("label is not null").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("int").alias("label"), F.xxhash64("url").alias("h"))
    rows = told.where("host != ''").orderBy("h", "host", "path", "label").limit(max_rows).toArrow()
    strings = [rows[c].combine_chunks().cast(pa.string()) for c in ("host", "path")]
    return fit(*strings, rows["label"].to_numpy().astype(np.int64), l2, buckets)


def _scores(host: pa.Array, path: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    row, place, scale = _features(host, path, len(weights) // 2)
    return bias + scale * np.bincount(row, weights[place], minlength=len(host))


def judge_urls(
    pages: DataFrame, model: tuple[np.ndarray, float], rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row: the longest rule that fits decides, else the model (score, its log odds, from 0 on: block).

    Scan-local; only the two columns are read. A null URL or one without :// has an empty host and path, which no rule with a
    path fits and the model judges as it judges no n-grams. A null page_id stays null; rows that repeat each give a row; an
    empty table gives no rows. Weights are 2 * buckets numbers, 1 MB, whatever the tables hold.
    """
    weights, bias = model
    url = pages[url_col]
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = _scores(batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string()), weights, bias)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], ["page_id", "host", "path", "score"])

        return apply

    scored = over_batches(rows, make, "page_id long, host string, path string, score double")
    ruled = scored.withColumn("by", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("by.verdict"), F.when(F.col("score") >= 0, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "score")

