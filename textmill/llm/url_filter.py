"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

The model is fitted on the driver to a small labelled table of URLs (a parameter; at most ``MAX_LABELLED`` rows), by
gradient descent with a quadratic penalty on the weights (not on the bias), from zero, so the result is the same each time.
Features are the n-grams of 3 to 5 characters of the host and of the path, each with marks at its ends and digits made one,
hashed to ``DIM`` places; a URL's vector has length one. What goes to the workers is one vector of ``DIM`` weights, whatever
the size of the input.

The built-in table has URLs of topics: a host of one or two words of the topic, a path of further words of it or of words
that all sites use. An unwanted word that the table lacks is mostly found by the other words beside it, or by parts that it
shares with known ones; alone and unlike any of them it is allowed (:func:`held_out` measures both).

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule, has no features and is allowed; an
empty table gives an empty table; repeated rows are judged each by itself; other columns are ignored by :func:`judge`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import col

DIM, SIZES, MAX_LABELLED = 1 << 18, (3, 4, 5), 20_000
#: The smallest multiple of 0.05 at which at most one in twenty URLs of wanted words that the model has not seen is blocked (:func:`held_out`).
THRESHOLD = 0.6
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The built-in labelled table is built from these topics by the rule in :func:`topic_urls`.
UNWANTED = (
    "casino win jackpot slots poker free-bets betting bets roulette bonus spins blackjack bingo gambling sportsbook vegas baccarat lottery wager odds pokerstars casinos bet365 betwin luckyslots casino-online",
    "adult-x porn xxx sexcam escort nude webcam hentai erotic milf hot-girls sex porno fetish hookup naked adult strip camgirls sexy xxxvideos pornhub sexvideos adult-chat livesex nudes",
    "cheap-pills viagra cialis pharma-deal rx no-prescription tramadol xanax weight-loss diet-pills meds generic-drugs levitra pill-store steroids cheap-meds pharmacy-online kamagra pills valium cheapviagra pharma-online pillshop buy-xanax",
    "ads-track adserver tracker popads banner-ads tracking pixel clickbait popunder doubleclick ad-network affiliate adclick ads retarget impression beacon adsense redirect adtag adclicks bannerads trackers",
    "spam-farm link-farm seo-links spam spammer buy-links backlinks doorway auto-blog article-spinner link-exchange guest-post seo-boost traffic-bot bulk-mail mailer spun-content linkbuilding buy-traffic farm-links spamlinks seospam spamlinks seospam",
    "payday-loan fast-cash crypto-double free-prize winner giveaway bitcoin-double quick-loan instant-credit get-rich earn-money make-cash forex-robot pyramid investment-guru lucky-winner claim-prize cash-now double-profit gift-card-free fastloans freecash loans",
    "warez cracked keygen torrent serial-keys pirate nulled free-download crack torrents full-version movie-rip fake-id activator license-key patch-download rapidfile illegal-stream repack hacked warezone cracks keygens",
)
WANTED = (
    "news gazette journal edition reporter politics parliament council nation world editorial weather-report headlines magazine opinion archive interview press daily chronicle",
    "library museum history archive-hall gallery exhibition manuscripts heritage culture theatre poetry authors letters opera festival orchestra cinema painting sculpture monuments",
    "school university student college academy lectures physics biology chemistry research thesis mathematics science alumni campus dictionary encyclopedia language grammar homework",
    "garden recipes kitchen bakery cookbook coffee chocolate restaurant wine pizza farm market organic vegetables bread cheese breakfast dinner flowers orchard",
    "hospital health clinic doctor dentist nursing medicine pharmacist therapy wellness fitness yoga nutrition patients surgery pediatrics vaccination emergency hygiene sleep",
    "travel maps railway harbour airport hotel tickets sailing mountain village islands river coast camping cycling tourism hiking beaches trains adventure",
    "python kernel software developer docs manual wiki forum code cloud computer open-data engine hardware database compiler networking support releases tutorials",
    "football tennis cricket chess running athletics championship league stadium coach rugby swimming marathon gymnastics referee tournament scores club training olympics",
    "bank insurance mortgage-advice credit-union finance lawyer company careers jobs office accounting taxes business economy industry pension invoice consulting charity volunteer",
    "alphabet better between diabetes tibet essex sussex unisex sextant bethlehem roads downloads heads beads adapter address advice slate pillow popular",
    "north month earth than-ever other-side thirst honest ornithology hand-made able-seaman fashion shore hence orient athens breath wheat western rather thunder",
    "family kids parents pets dogs cats birds horses photos music radio television books shop store furniture clothes shoes wedding gifts",
    "trackfield crackers banner pilot adverb window winter wind spinning bonnet poetic betty maddox shadow camera camp model cashmere locksmith keyboard",
    "github wikipedia weather community projects photography calendar mail notes blogger design studio digital learning online video player portal search account",
)
#: Words that paths of all kinds of sites have.
COMMON = ("en", "de", "fr", "index.html", "page", "article", "login", "search", "about", "contact", "images", "category", "tag", "item", "view", "home")


def topic_urls(words: list[str], others: list[str], label: int) -> list[tuple[str, int]]:
    """``(url, label)``: hosts of each of ``words`` alone, beside others of the topic, and without its hyphen; paths of common or of the topic's words."""
    out = []
    for k, w in enumerate(words):
        near = [x for x in others if x != w] or [w]
        b, c, d = (near[(j * k + j) % len(near)] for j in (1, 3, 7))
        x, y, n = COMMON[k % len(COMMON)], COMMON[(5 * k + 3) % len(COMMON)], 7 * k + 12
        plain, tight = w.replace("-", ""), b.replace("-", "")
        out += [
            f"https://www.{w}.example.com/{x}/{n}", f"http://{w}.example.net/{y}/{n}.html", f"https://m.{w}.example.org/{x}/", f"http://blog.{w}.example.com/{c}/{n}", f"https://{plain}.com/", f"https://www.{w}-{b}.com/{c}",
            f"http://{plain}{tight}.net/{y}/{d}", f"https://{tight}{plain}.org/{x}?id={n}", f"https://online{plain}.com/{y}", f"http://best{plain}.info/{c}/{d}", f"https://my{plain}s.tv/", f"https://{b}.example.org/{w}/{c}-{n}",
        ]
    return [(u, label) for u in out]


def labelled_urls() -> list[tuple[str, int]]:
    """``(url, 1 if unwanted)``: the built-in table."""
    return [row for topics, label in ((UNWANTED, 1), (WANTED, 0)) for t in topics for row in topic_urls(t.split(), t.split(), label)]


def parts_of(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path of a URL."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(maxsize=50_000)
def _grams(text: str, tag: str) -> tuple[int, ...]:
    if not text:
        return ()
    s = f"^{re.sub('[0-9]+', '0', text)}$"
    return tuple(zlib.crc32(f"{tag}{s[i : i + n]}".encode("utf-8", "surrogatepass")) % DIM for n in SIZES for i in range(len(s) - n + 1))


def gram_places(host: str, path: str) -> tuple[int, ...]:
    return _grams(host, "h") + _grams(path.lower(), "p")


def vectors(parts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and rows of the URLs' vectors: counts of n-grams, each vector of length one."""
    rows = [gram_places(h, p) for h, p in parts]
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=len(who))
    cell, n = np.unique(who * DIM + at, return_counts=True)
    who, at = cell // DIM, cell % DIM
    size = np.sqrt(np.bincount(who, n.astype(float) ** 2, len(rows)))
    return at, n / size[who], who


def fit(labelled: list[tuple[str, int]], penalty: float = 1e-5, rounds: int = 300, rate: float = 60.0) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with momentum; classes weigh the same, however many rows each has."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs")
    w, bias, y = np.zeros(DIM), 0.0, np.array([float(label) for _, label in labelled])
    if not len(y):
        return w, float(np.log(1 / 19))
    at, value, who = vectors([parts_of(u) for u, _ in labelled])
    used, at = np.unique(at, return_inverse=True)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    v, step, step_b = np.zeros(len(used)), np.zeros(len(used)), 0.0
    for _ in range(rounds):
        off = (1 / (1 + np.exp(-np.bincount(who, v[at] * value, len(y)) - bias)) - y) * share
        step = 0.9 * step - rate * (np.bincount(at, off[who] * value, len(used)) + penalty * v)
        step_b = 0.9 * step_b - 0.02 * rate * off.sum()
        v, bias = v + step, bias + step_b
    w[used] = v
    return w, bias


def chances(w: np.ndarray, bias: float, parts: list[tuple[str, str]]) -> np.ndarray:
    """Probabilities that URLs are unwanted; 0 for those without features."""
    at, value, who = vectors(parts)
    z = np.bincount(who, w[at] * value, len(parts)) + bias
    return np.where(np.bincount(who, minlength=len(parts)) > 0, 1 / (1 + np.exp(-z)), 0.0)


def chance(w: np.ndarray, bias: float, host: str, path: str) -> float:
    return float(chances(w, bias, [(host, path)])[0])


def held_out(parts: int = 4, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and labels of URLs of words that the model has not seen, a ``parts``-th of every topic's words at a time.

    The words beside a new one are those that the model has seen, or with ``alone`` new ones too.
    """
    p, y = [], []
    for k in range(parts):
        seen, new = [], []
        for topics, label in ((UNWANTED, 1), (WANTED, 0)):
            for t in topics:
                old, fresh = ([w for i, w in enumerate(t.split()) if (i % parts == k) == out] for out in (False, True))
                seen += topic_urls(old, old, label)
                new += topic_urls(fresh, fresh if alone else old, label)
        w, b = fit(seen)
        p.append(chances(w, b, [parts_of(u) for u, _ in new]))
        y += [label for _, label in new]
    return np.concatenate(p), np.array(y)


def host_of(url: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; nulls if none does. Rules are written host first, from the first slash on path."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        h, slash, p = rule.partition("/")
        fits.append((((host == h) | host.endswith("." + h)) & path.startswith(slash + p), rule, verdict))
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r, _ in fits], F.lit(None).cast("string")), F.coalesce(*[F.when(c, F.lit(v)) for c, _, v in fits], F.lit(None).cast("string"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", labelled: list[tuple[str, int]] | None = None, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block`` of every row."""
    w, bias = fit(labelled_urls() if labelled is None else labelled)
    shared = pages.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def model(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(chances(shared.value, bias, list(zip(hosts, paths, strict=True))), dtype=float)

    rows = pages.select(col(id_col).alias("page_id"), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), model.asNondeterministic()("host", "path").alias("p_block"))
    own = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), F.round("p_block", 9).alias("p_block"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
