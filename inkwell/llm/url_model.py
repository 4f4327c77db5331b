"""URL filters: host and path rules, and for the rest logistic regression on hashed character n-grams.

The host stands after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; the path follows
up to "?", "#" or the end. A rule is (verdict, host, path); it fits its host and all subdomains if the
path starts with the rule's; the longest rule wins.

The model is learned by FTRL on the driver from LABELLED, a small table of urls by hand (a parameter).
Host and path are cut into n-grams of 3 to 5 characters with a mark at either end, digits made alike,
hashed to 2^16 places apart from each other; values are scaled to length 1 within the host and to a
quarter within the path, which tells less.

Defined results: a null url, or one without "://", has an empty host and path, no rule, and the score
of the bias and the two empty marks; repeated rows get equal rows; a null page_id passes through; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import table
from inkwell.llm.quality_model import Ftrl, sigmoid

BITS, EPOCHS, THRESHOLD = 16, 100, 0.5
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Urls to be blocked, by family, and allowed ones, made up without a look at any crawl.
BLOCKED = {
    "medicine": "viagra-shop.example/order rx-discount.example/en/12 no-prescription.example/checkout cialis-express.example/ generic-meds.example/fr/9 slimming-tablets.example/special",
    "gambling": "poker-room.example/play jackpot-slots.example/de/3 roulette-live.example/bonus blackjack-tables.example/en/77 lucky-lotto.example/es/5 bookmaker-odds.example/join",
    "sex": "sexcams.example/live porn-tube.example/en/1 nude-pics.example/gallery erotic-chat.example/fr/2 escort-girls.example/de/9 hot-singles.example/es/14",
    "links": "backlinks-seo.example/buy seo-booster.example/en/4 link-exchange.example/es/31 article-spinner.example/a bulk-mailer.example/list comment-poster.example/de/6",
    "clicks": "popunder-network.example/click banner-clicks.example/in?x=1 retarget-pixel.example/p.gif sponsored-offers.example/en/8 affiliate-clicks.example/go clickbait-news.example/fr/3",
    "fraud": "payday-loans.example/apply replica-watches.example/buy crypto-doubler.example/now keygen-crack.example/download get-rich-quick.example/ miracle-diet.example/es/2",
}
ALLOWED = """
library.example/en/12 news.example/de/44 gardens.example/en/7.html university.example/fr/3 museum.example/es/19 docs.project.example/guide
weather.example/en/101 townhall.example/de/5/ recipes.example/fr/61.html history.example/en/9?page=2 science.example/article/77 school.example/es/8
forum.linux.example/en/32 travel.example/fr/15 hospital.example/de/2 maps.example/en/ journal.example/2020/01/review.html theatre.example/en/66
archive.example/en/1000 council.example/en/policy orchestra.example/concerts bakery.example/bread chess.example/en/rules botany.example/plants/oak
railway.example/timetable bookshop.example/de/70 astronomy.example/en/moon cycling-club.example/fr/18 parish.example/es/4 language-course.example/en/5
charity.example/donate chemistry.example/de/21 county-court.example/en/3 knitting.example/fr/44 painting.example/es/27 geology.example/en/rocks
bird-watching.example/de/8 sailing-school.example/en/16 village.example/fr/6 choir.example/concerts translation.example/es/52 mountain-hut.example/de/11
"""


def labelled(blocked: Iterable[str] = BLOCKED.values(), allowed: str = ALLOWED) -> tuple[tuple[str, int], ...]:
    """(url, 1 if it is to be blocked), each under several subdomains and top-level domains, so that these say nothing."""
    under = (("", "com"), ("www.", "org"), ("blog.", "net"), ("m.", "com"))
    rows = [(u, y) for texts, y in ((blocked, 1), ([allowed], 0)) for text in texts for u in text.split()]
    return tuple((f"https://{sub}{u.replace('.example/', f'.example.{top}/', 1)}", y) for u, y in rows for sub, top in under)


LABELLED = labelled()


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """STRUCT<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):  # the last one set is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    return "".join(c.lower() if c in UPPER else c for c in rest[:end]), tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]


def grams(text: str, family: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the n-grams of a host or a path."""
    marked = "^" + "".join("0" if c.isdigit() else c for c in text) + "$"
    found = {zlib.crc32(f"{family}{marked[i : i + n]}".encode()) >> (32 - bits) for n in (3, 4, 5) for i in range(max(1, len(marked) - n + 1))}
    places = np.array(sorted(found), np.int64)
    return places, np.full(len(places), (1.0 if family == "h" else 0.25) / np.sqrt(len(places)))


def train(labelled: Iterable[tuple[str, int]] = LABELLED, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    model = Ftrl(1 << bits, alpha=0.5, l1=0.0, l2=0.001)
    rows = []
    for url, y in labelled:
        h, p = split_url(url)
        a, b = grams(h, "h", bits), grams(p, "p", bits)
        places = np.concatenate([a[0], b[0]])
        at, inverse = np.unique(places, return_inverse=True)
        rows.append((at, np.bincount(inverse, np.concatenate([a[1], b[1]])), y))
    rows.sort(key=lambda r: zlib.crc32(r[0].tobytes()))
    for _ in range(epochs):
        for row in rows:
            model.learn(*row)
    return model.weights().astype(np.float32)


def scored(pages: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """pages (page_id, host, path, ...) with score, the chance that the url is to be blocked."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value

        @lru_cache(maxsize=100_000)
        def part(text: str, family: str) -> float:
            places, values = grams(text, family, bits)
            return float(w[places] @ values)

        for batch in batches:
            found = [float(sigmoid(part(h, "h") + part(p, "p") + float(w[-1]))) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("score", T.DoubleType())]))


def judged(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row per page."""
    cut = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    out = scored(cut, train() if weights is None else weights)
    own = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return out.withColumn("m", matched(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", own).alias("verdict"), "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
