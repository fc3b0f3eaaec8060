"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest.

The model is fitted on the driver from the small labelled table below, whose size is fixed; its
weights, rounded to integers, become one literal of the scoring expression. Judging the pages is
DataFrame functions alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, BUCKETS, EPOCHS, RATE, PENALTY = 3, 1024, 300, 0.5, 1e-3
#: Weights are integers of this many to the unit, so that sums don't depend on their order.
UNIT = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The labelled table, (host, path) of urls to block and to allow.
BLOCKED = """
casino-royal.example.net/play best-casino.example.com/bonus/1 casino-win.example.org/en/11 online-casino.example.net/slots
cheap-pills.example.com/buy/2 cheap-meds.example.org/order pills-shop.example.net/en/40 discount-pills.example.com/fr/7
spam-farm.example.net/en/12 link-farm.example.com/out/9 spam-links.example.org/go article-spam.example.net/de/3
free-bets.example.com/win/5 sports-bets.example.net/odds free-spins.example.org/en/8 bets-online.example.com/es/21
adult-x.example.org/video/4 adult-cams.example.net/live xxx-adult.example.com/en/77 x-adult-club.example.net/fr/2
ads-track.example.net/click ads-server.example.org/banner/3 track-ads.example.com/pixel ad-track.example.net/en/60
free-money.example.com/get-rich win-prize.example.org/claim cheap-replica.example.net/watches payday-loans.example.com/apply
""".split()
ALLOWED = """
www.library.example.org/catalogue/12 news.example.com/en/2024/05/story blog.gardening.example.net/roses docs.python.example.org/en/3
university.example.org/research/88 www.museum.example.com/fr/visit m.weather.example.net/de/berlin recipes.example.com/en/41.html
history.example.org/es/315 forum.cycling.example.net/thread/9 www.theatre.example.com/en/7/ city-council.example.org/minutes
blog.theory.example.com/en/53 www.nature.example.net/fr/120 therapy.example.org/de/19 m.mathematics.example.com/es/6
the-times.example.com/en/900 thing.example.net/en/14 motion.example.org/en/720 station.example.com/en/35
blog.nation.example.net/en/6 other.example.org/fr/44 www.earth.example.com/es/95 m.water.example.net/de/310
www.books.example.net/shelf/4 library.example.com/books/31 blog.kitchen.example.net/soup archive.example.net/en/8
school.example.net/de/12 www.hospital.example.net/fr/3 parliament.example.net/debates m.football.example.net/en/66
gardens.example.net/es/5 poetry.example.net/en/19.html www.physics.example.net/lectures/2 travel.example.net/de/81
open-source.example.org/project/5 well-known.example.com/en/2 co-operative.example.net/about long-read.example.org/en/18
""".split()


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules in force.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _gram_bucket(a: int, b: int, c: int, salt: int) -> int:
    return (a * 7919 + b * 131 + c * 17 + salt) % BUCKETS


def grams(host: str, path: str) -> list[int]:
    """Buckets of the n-grams of ^host$ and ^path$, the two under different salts."""
    out = []
    for salt, text in enumerate((host, path)):
        codes = [ord(c) for c in f"^{text}$"]
        out += [_gram_bucket(*codes[i : i + 3], salt * 509) for i in range(len(codes) - 2)]
    return out


@cache
def weights() -> tuple[int, ...]:
    """Logistic regression by full-batch descent on n-gram shares; the last weight is the constant."""
    rows = [(grams(h, "/" + p), y) for y, table in ((1, BLOCKED), (0, ALLOWED)) for h, _, p in (u.partition("/") for u in table)]
    w = [0.0] * (BUCKETS + 1)
    for _ in range(EPOCHS):
        step = [PENALTY * x for x in w]
        for found, y in rows:
            error = (1 / (1 + math.exp(-w[-1] - sum(w[g] for g in found))) - y) / len(rows)
            for g in found:
                step[g] += error
            step[-1] += error
        w = [x - RATE * s for x, s in zip(w, step, strict=True)]
    return tuple(round(x * UNIT) for x in w)


def _gram_sum(text: Column, salt: int, table: Column) -> Column:
    codes = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c))
    codes = F.filter(codes, lambda c: c > 0)

    def pair(a: Column, b: Column) -> Column:
        return F.get(table, ((a["x"] * 7919 + a["y"] * 131 + b * 17 + F.lit(salt * 509)) % BUCKETS).cast("int"))

    pairs = F.arrays_zip(F.slice(codes, F.lit(1), F.size(codes) - 2).alias("x"), F.slice(codes, F.lit(2), F.size(codes) - 2).alias("y"), F.slice(codes, F.lit(3), F.size(codes) - 2).alias("z"))
    return F.when(F.size(codes) > 2, F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, p: acc + pair(p, p["z"]))).otherwise(F.lit(0).cast("long"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and logit (in UNITs) of every page.

    A rule fits its host and that host's subdomains where the path starts with the rule's; the
    longest fitting rule decides, of equally long ones the first listed. Where none fits, the model
    blocks at a logit of 0 or more. A null url or one without :// has an empty host and path and is
    judged by the model. Rows stay apart whatever their ids; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    longest_first = sorted(rules, key=lambda r: -len(r.name))
    rule = verdict = None
    for r in longest_first:
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.name) if rule is None else rule.when(fits, r.name)
        verdict = F.when(fits, r.action) if verdict is None else verdict.when(fits, r.action)
    table = F.expr(f"array({', '.join(f'{w}L' for w in weights()[:-1])})")
    logit = _gram_sum(F.col("host"), 0, table) + _gram_sum(F.col("path"), 1, table) + F.lit(weights()[-1])
    rows = rows.withColumn("rule", F.lit(None).cast("string") if rule is None else rule).withColumn("logit", logit)
    model = F.when(F.col("logit") >= 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", (model if verdict is None else verdict.otherwise(model)).alias("verdict"), "logit")


def oracle() -> str:
    """judge() as DuckDB SQL."""
    table = f"[{', '.join(map(str, weights()[:-1]))}]"

    def total(name: str, salt: int) -> str:
        code = f"ord(substr(concat('^', {name}, '$'), i::INT{{}}, 1))"
        bucket = f"({code.format('')} * 7919 + {code.format(' + 1')} * 131 + {code.format(' + 2')} * 17 + {salt * 509}) % {BUCKETS}"
        return f"coalesce(list_sum(list_transform(range(1, length({name}) + 1), lambda i: w[({bucket}) + 1])), 0)"

    fits = [(f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))", r) for r in sorted(RULES, key=lambda r: -len(r.name))]
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
scored AS (SELECT page_id, host, path, CAST({total("host", 0)} + {total("path", 1)} + {weights()[-1]} AS BIGINT) AS logit FROM parts, (SELECT {table} AS w))
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{r.name}'" for f, r in fits)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{r.action}'" for f, r in fits)} WHEN logit >= 0 THEN 'block' ELSE 'allow' END AS verdict, logit
FROM scored"""
