"""Secret scan [native]: fixed patterns, and tokens that a character Markov model takes for random strings.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a token is a secret if its log-likelihood ratio per character reaches ``THRESHOLD``. Scanning
uses DataFrame functions only; the model enters the plan as a table of literals.
"""

from __future__ import annotations

import base64
import hashlib
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the same matches as AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # the same matches as [0-9a-f]+ of 32 characters or more
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"  # shorter strings tell random and ordinary apart too seldom
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
THRESHOLD = 0.35
SAMPLES = 4000
CHUNK = 256

# Words of which ordinary identifiers and texts are made.
PARTS = (
    "account action address array author batch block branch bucket buffer builder button cache call category change channel char check child class client code "
    "column command comment commit config connection container content context control controller copy count create current data date debug default delete "
    "description detail device directory display document domain driver element email enable entry error event example exception execute factory field file "
    "filter first folder format frame function group handler header helper history image import index input instance integer item kernel keyboard label language "
    "layer layout length level library limit line link list listener local location lock logger manager mapping match media member memory menu message method "
    "model module mouse name network node number object offset operation option order origin output package page parameter parent parser password path pattern "
    "payment pixel player plugin point policy position prefix price process product profile project property provider query queue random range record region "
    "register release remote render repository request resource response result return route row sample scale schema screen script search section security "
    "select server service session setting shape signal size snapshot socket source stack state static status storage stream string structure style system "
    "table target task template test text thread time title token track transaction transfer transform tree type update upload user utility validate value "
    "vector version video view visible widget window worker writer zone "
    "and are but for from have not that the their there they this was were what when which with would "
    "aber auch dass der die eine einer keit lich nicht schaft sich und ung verlichkeit wird "
    "avec dans des elle est les leurs mais nous par pas pour que qui sur tion une ment "
    "cion como con del esta este los mas para pero por que ser una mente "
    "ther thing ering ation ingly ness ment able ible ander enter inter"
).split()


def labelled_samples(n: int = SAMPLES) -> list[tuple[str, int]]:
    """Labelled strings, 1 for random ones and 0 for identifiers; ``n`` of each, the same at every call."""
    out = []
    for i in range(n):
        digest = hashlib.sha256(f"sample {i}".encode()).digest()
        cut = 16 + digest[0] % 24
        kind = i % 4
        if kind == 0:
            out.append((digest.hex()[:cut], 1))
        elif kind == 1:
            out.append((base64.b32encode(digest).decode()[:cut], 1))
        else:
            out.append((base64.b64encode(digest + digest[::-1]).decode()[:cut], 1))
        words = [PARTS[(digest[k] * 256 + digest[k + 1]) % len(PARTS)] for k in range(0, 8, 2)]
        style = digest[9] % 8
        if style == 0:
            text = "_".join(words)
        elif style == 1:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif style == 2:
            text = "-".join(words)
        elif style == 3:
            text = "/".join(words)
        elif style == 4:
            text = "".join(words)
        elif style == 5:
            text = "_".join(words).upper()
        elif style == 6:  # plain numbers are ordinary
            text = str(int.from_bytes(digest[13:23], "big"))[:cut]
        else:
            text = f"{words[0]}_{words[1]}/{2000 + digest[10] % 30}-{1 + digest[11] % 12:02d}-{1 + digest[12] % 28:02d}_{words[2]}"
        out.append((text, 0))
    return out


def train(samples: list[tuple[str, int]], smooth: float = 0.3) -> list[float]:
    """Log-likelihood ratios of the transitions, row by row of ``ALPHABET``; characters outside it are skipped."""
    size = len(ALPHABET)
    at = {c: k for k, c in enumerate(ALPHABET)}
    counts = [[[smooth] * size for _ in range(size)] for _ in range(2)]
    for text, label in samples:
        for a, b in zip(text, text[1:]):
            if a in at and b in at:
                counts[label][at[a]][at[b]] += 1
    ratios = []
    for a in range(size):
        plain, random = sum(counts[0][a]), sum(counts[1][a])
        ratios += [round(math.log(counts[1][a][b] / random) - math.log(counts[0][a][b] / plain), 4) for b in range(size)]
    return ratios


@lru_cache
def model() -> tuple[float, ...]:
    return tuple(train(labelled_samples()))


def llr(token: Column, ratios: tuple[float, ...] | None = None) -> Column:
    """Log-likelihood ratio of a token per transition; tokens of one character score 0."""
    ratios = ratios or model()
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    n = F.length(token) - 1
    place = lambda i: F.instr(F.lit(ALPHABET), token.substr(i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.when(i <= n, F.element_at(weights, (place(i) - 1) * len(ALPHABET) + place(i + 1))).otherwise(F.lit(0.0)))
    return total / F.greatest(n, F.lit(1))


def starts(values: Column, gaps: Column) -> Column:
    """Array of (start, value) of matches, start in code points from 0, from what lies between them.

    The offsets are running sums; they run over chunks, so a text with very many matches costs little more than
    their number.
    """
    kind = "array<struct<start:int,value:string>>"
    pairs = lambda i: F.zip_with(F.slice(gaps, i * CHUNK + 1, F.least(F.lit(CHUNK), F.size(values) - i * CHUNK)), F.slice(values, i * CHUNK + 1, F.lit(CHUNK)), lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    step = lambda acc, x: F.struct((acc["pos"] + x["gap"] + F.length(x["value"])).alias("pos"), F.concat(acc["out"], F.array(F.struct((acc["pos"] + x["gap"]).alias("start"), x["value"].alias("value")))).alias("out"))
    inner = lambda acc, i: F.aggregate(pairs(i), F.struct(acc["pos"].alias("pos"), F.array().cast(kind).alias("out")), step)
    added = lambda acc, r: F.struct(r["pos"].alias("pos"), F.concat(acc["outs"], F.array(r["out"])).alias("outs"))
    return F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")),
        F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{kind}>").alias("outs")),
        lambda acc, i: F.element_at(F.transform(F.array(inner(acc, i)), lambda r: added(acc, r)), 1),
        lambda acc: F.flatten(acc["outs"]),
    )


def scan_secrets(docs: DataFrame, text: str = "text", spans: str = "secrets", ratios: tuple[float, ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds an array of (start, rank, end, kind, value), sorted: code points, end exclusive, rank by ``KINDS``.

    ``value`` is what should be hidden: the assigned value of an assignment, else the whole span. Spans of the
    fixed patterns stay as they are; a random token is added where it overlaps none of them. Null and empty
    texts have none; a column of the same name is replaced.
    """
    body = F.coalesce(docs[text], F.lit(""))
    names, gaps, patterns = [fresh(docs, f"_found_{k}") for k in KINDS], [fresh(docs, f"_gaps_{k}") for k in KINDS], (ASSIGN, ACCESS, HEX, TOKEN)
    kept = fresh(docs, "_base")
    found = docs.drop(spans).withColumns({n: F.regexp_extract_all(body, F.lit(p), F.lit(0)) for n, p in zip(names, patterns)})
    found = found.withColumns({g: F.when(F.size(n) > 0, F.split(body, p, -1)) for g, n, p in zip(gaps, names, patterns)})
    none = F.array().cast("array<struct<start:int,value:string>>")
    found = found.withColumns({n: F.when(F.size(n) > 0, starts(F.col(n), F.col(g))).otherwise(none) for g, n in zip(gaps, names)})
    hidden = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    made = lambda k, value: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("rank"), (m["start"] + F.length(m["value"])).alias("end"), F.lit(KINDS[k]).alias("kind"), value(m).alias("value"))
    whole = lambda m: m["value"]
    assign = F.transform(F.filter(names[0], lambda m: F.length(hidden(m)) >= 8), made(0, hidden))
    base = F.concat(assign, F.transform(names[1], made(1, whole)), F.transform(names[2], made(2, whole)))
    found = found.withColumn(kept, base)
    free = lambda m: ~F.exists(kept, lambda b: (b["start"] < m["start"] + F.length(m["value"])) & (m["start"] < b["end"]))
    random = F.filter(names[3], lambda m: free(m) & (llr(m["value"], ratios) >= threshold))
    return found.withColumn(spans, F.array_sort(F.concat(kept, F.transform(random, made(3, whole))))).drop(kept, *names, *gaps)


def masked(docs: DataFrame, text: str = "text", mask: str = "[secret]", **options) -> DataFrame:
    """The input with every secret's value replaced by ``mask``; null texts stay null, other columns as they are."""
    found = fresh(docs, "_secrets")
    scanned = scan_secrets(docs, text, found, **options)
    values = F.transform(F.col(found), lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end")))
    step = lambda acc, s: F.when(s["start"] >= acc["pos"], F.struct(F.concat(acc["out"], F.array(F.col(f"`{text}`").substr(acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mask))).alias("out"), s["end"].alias("pos"))).otherwise(acc)
    whole = F.aggregate(values, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("pos")), step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.col(f"`{text}`").substr(acc["pos"] + 1, F.length(F.col(f"`{text}`")))))
    return scanned.withColumn(text, F.when(F.size(found) > 0, whole).otherwise(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])
