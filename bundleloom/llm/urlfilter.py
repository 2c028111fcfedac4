"""URL filter: explicit rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained with numpy on the driver from ``EXAMPLES``, a small table of labelled URLs of distinct hosts; its
weights (``BUCKETS`` numbers) go with the tasks.  Host, path and rules are plain column expressions.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule, and the verdict the
model gives to empty input; repeated rows are judged alike; any length of url is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundleloom.llm.common import per_batch

BUCKETS = 1 << 13
SIZES = (3, 4, 5)

# Verdict, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Labelled URLs, one for each host: to refuse (gambling, adult, pills, loans, fakes, cracks, link farms, prizes) and to admit.
REFUSED = """
http://spam-farm.example.org/en/links http://best-casino-bonus.example.com/spin http://online-casino.example.org/slots/free-spins http://casino-royal.example.net/jackpot
http://lucky-slots.example.com/casino/bonus http://poker-bonus.example.org/play http://online-poker.example.com/join-now http://free-slots-casino.example.net/
http://sports-betting-tips.example.com/bet http://bet-win-online.example.org/bonus http://casino-win.example.info/en/ http://mega-jackpot.example.com/win/prize
http://win-free-prize.example.org/claim.html http://free-iphone-prize.example.com/winner http://win-money-now.example.net/claim http://cash-prize-winner.example.org/free
http://xxx-videos.example.com/free-porn http://free-porn-tube.example.org/xxx http://adult-cams.example.net/live-sex http://live-sex-cams.example.com/adult
http://hot-singles.example.org/dating http://adult-dating-tonight.example.com/hot http://sexy-girls-cams.example.net/xxx http://nude-cams.example.org/live
http://xxx-adult-movies.example.com/hot http://escort-girls.example.org/hot-singles http://cheap-pills.example.com/buy-now http://buy-viagra-online.example.org/cheap
http://viagra-shop.example.net/pills http://cheap-cialis-pills.example.com/order http://online-pharmacy-pills.example.org/no-prescription http://diet-pills-fast.example.com/buy
http://weight-loss-pills.example.net/buy-cheap http://no-prescription-meds.example.org/cheap http://payday-loans.example.com/apply-now http://fast-cash-loans.example.org/payday
http://instant-loans-online.example.net/cash http://bad-credit-loans.example.com/apply http://cheap-payday-cash.example.org/loans http://easy-money-loans.example.info/now
http://free-money.example.org/make-money-fast http://make-money-fast.example.com/get-rich http://get-rich-quick.example.net/money http://earn-cash-online.example.org/money-fast
http://crypto-doubler.example.com/get-rich http://free-bitcoin-doubler.example.org/claim http://replica-watches.example.com/cheap-replica http://fake-rolex-replica.example.org/buy
http://replica-handbags.example.net/cheap http://cheap-replica-shoes.example.com/buy-now http://fake-id-shop.example.org/buy http://warez-crack.example.com/keygen
http://cracked-software.example.org/warez http://keygen-serial-crack.example.net/download http://free-crack-download.example.com/keygen http://malware-download.example.org/setup.exe
http://torrent-warez.example.com/crack http://nulled-scripts-crack.example.org/free-download http://game-hacks-crack.example.net/keygen http://free-keygen.example.info/crack.exe
http://seo-links.example.com/buy-links http://buy-backlinks.example.org/seo http://cheap-seo-backlinks.example.net/links http://link-farm-seo.example.com/buy
http://click-bait.example.org/you-wont-believe http://spam-links-farm.example.com/seo http://free-traffic-seo.example.net/links http://buy-followers-cheap.example.org/links
http://virus-alert-support.example.com/call-now http://account-verify-login.example.org/secure-update http://secure-bank-login-verify.example.net/account http://verify-account-update.example.com/login
""".split()  # fmt: skip
ADMITTED = """
http://www.library.example.org/catalogue/2019 http://university-library.example.com/collections/maps http://public-library.example.net/events/reading http://national-archive.example.org/records/1901
http://news.example.com/world/2021/03/election http://daily-news.example.org/politics/budget http://local-news.example.net/city/council http://evening-post.example.com/sport/football
http://weather.example.com/forecast/monday http://weather-service.example.org/rain/radar http://climate-data.example.net/temperature/series http://docs.python.example.org/3/library/re.html
http://docs.example.com/guide/install.html http://developer-docs.example.org/api/reference http://manual.example.net/chapter/two http://wiki.history.example.org/article/rome
http://encyclopedia.example.com/article/photosynthesis http://history-museum.example.org/exhibits/bronze-age http://www.museum.example.net/visit/opening-hours http://art-gallery.example.com/paintings/landscape
http://university.example.com/courses/biology http://physics-department.example.org/lectures/optics http://school.example.net/calendar/term http://primary-school.example.com/parents/letter
http://college-admissions.example.org/apply/undergraduate http://science-journal.example.com/article/genome http://medical-journal.example.org/issue/12/cardiology http://astronomy.example.net/telescope/images
http://blog.gardening.example.com/roses/pruning http://garden-plants.example.org/vegetables/tomato http://recipes.example.com/soup/lentil http://m.recipes.example.org/bread/sourdough
http://cooking-at-home.example.net/dinner/pasta http://baking.example.com/cakes/lemon http://forum.cycling.example.com/thread/gears http://bicycle-repair.example.org/wheels/spokes
http://hiking-trails.example.net/mountains/map http://travel-guide.example.com/italy/florence http://railway-timetable.example.org/stations/north http://city-transport.example.net/bus/lines
http://parliament.example.org/debates/2020 http://city-council.example.com/minutes/may http://government-statistics.example.net/population/census http://tax-office.example.org/forms/annual
http://hospital.example.com/departments/paediatrics http://health-service.example.org/vaccination/schedule http://dental-practice.example.net/appointments http://animal-shelter.example.com/adopt/dogs
http://birdwatching.example.org/species/heron http://wildlife-trust.example.net/reserves/wetland http://zoo.example.com/animals/penguins http://marine-biology.example.org/coral/reef
http://poetry.example.com/sonnets/spring http://short-stories.example.org/authors/chekhov http://bookshop.example.net/novels/classics http://book-reviews.example.com/history/medieval
http://orchestra.example.org/concerts/autumn http://piano-lessons.example.com/beginners/scales http://theatre.example.net/programme/hamlet http://folk-music.example.org/songs/ballads
http://open-source-project.example.com/releases/changelog http://code-hosting.example.org/project/issues http://programming-tutorial.example.net/loops/examples http://mathematics.example.com/algebra/groups
http://statistics-course.example.org/regression/notes http://chemistry-lab.example.net/safety/rules http://geology-society.example.com/minerals/quartz http://maps.example.org/region/coast
http://football-club.example.com/fixtures/saturday http://tennis-club.example.org/members/courts http://chess.example.net/openings/sicilian http://swimming-pool.example.com/timetable
http://community-centre.example.org/classes/pottery http://village-hall.example.net/notices http://church-history.example.com/buildings/tower http://charity.example.org/volunteer/report
http://knitting-patterns.example.com/scarf/wool http://woodworking.example.org/joints/dovetail http://photography.example.net/portrait/light http://film-festival.example.com/programme/documentary
http://language-school.example.org/german/grammar http://dictionary.example.com/word/meadow http://translation-notes.example.net/french/idioms http://linguistics.example.org/phonology/vowels
http://farmers-market.example.com/season/apples http://energy-agency.example.org/solar/report http://engineering.example.net/bridges/steel http://research-institute.example.com/publications/annual
""".split()  # fmt: skip
EXAMPLES = tuple((u, 1) for u in REFUSED) + tuple((u, 0) for u in ADMITTED)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> list[int]:
    """Buckets of the character n-grams of host and path, each marked with its part."""
    out = set()
    for part, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        out.update(xxhash.xxh32_intdigest(f"{part}{s[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in SIZES for i in range(len(s) - n + 1))
    return sorted(out)


def split_url(url: str) -> tuple[str, str]:
    """Plain form of :func:`host_path`, for the examples."""
    rest = url.partition("://")[2]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    return host.lower(), tail[: min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))]


def train(examples=EXAMPLES, steps: int = 600, rate: float = 8.0, decay: float = 3e-4) -> np.ndarray:
    """Weights by bucket, the bias last; each example's n-grams share unit length."""
    x = np.zeros((len(examples), BUCKETS + 1))
    for i, (url, _) in enumerate(examples):
        b = grams(*split_url(url))
        x[i, b] = 1 / np.sqrt(len(b))
    x[:, -1] = 1
    y, w = np.array([label for _, label in examples], float), np.zeros(BUCKETS + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) / len(y)
        g[:-1] += decay * w[:-1]
        w -= rate * g
    return w


def blocked(w: np.ndarray, host: str, path: str) -> float:
    """Probability that a url should be refused."""
    b = grams(host, path)
    z = w[-1] + (w[b].sum() / np.sqrt(len(b)) if b else 0.0)
    return float(1 / (1 + np.exp(-z)))


def judge(pages: DataFrame, threshold: float = 0.5, examples=EXAMPLES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability for each row."""
    w = train(examples)
    host, path = host_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    parts = parts.select("page_id", host.alias("host"), path.alias("path"))

    def run(batches):
        for b in batches:
            seen: dict = {}
            p = [seen[k] if k in seen else seen.setdefault(k, blocked(w, *k)) for k in zip(b["host"].to_pylist(), b["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "p_block"])

    scored = parts.mapInArrow(run, "page_id long, host string, path string, p_block double")
    rule, said = rule_for(F.col("host"), F.col("path"))
    own = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "p_block")
