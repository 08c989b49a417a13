"""Secret scans with a random forest that removes false positives (operator 8).

Patterns propose candidates: key-shaped values, values assigned to credential names, and long
mixed strings, all of any length.  Each is described by its length, character transitions, dictionary coverage, path marks
and neighbouring words (the ``BEFORE`` characters before it and the ``AFTER`` behind), and a random forest decides.  The forest is trained on the driver from labelled
findings, a table of value, text before, text after and label; by default a seeded list of
``FINDINGS`` made from known key formats and known kinds of false positives.  Its trees become one SQL
expression, so scanning and redaction are DataFrame code without a shuffle.

Nulls and edge cases: a null or empty text has no findings and stays as it is; matches do not
overlap and are taken from left to right; repeated rows are scanned each; an empty table gives an
empty result; only doc_id and text are read, and other columns pass through redaction.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table

NAMES = r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?)"
ASSIGNED = rf"(?i:(?<![A-Za-z0-9]){NAMES}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)(?!-----BEGIN )([^\s\"'<>,;]{{6,}})"
PREFIXED = r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|xox[abprs]-[\w-]{10,}|[sr]k_(?:live|test)_\w{10,}|AIza[\w-]{30,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN )[\s\S]){16,}?-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
MIXED = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*+[0-9])[A-Za-z0-9+/_=.-]{24,}"
CANDIDATE = "|".join((BLOCK, ASSIGNED, PREFIXED, MIXED))

#: Character runs and words that secrets seldom hold.
DICTIONARY = (
    "password passwd secret token example sample test your here change changeme insert replace dummy user name admin login "
    "path file index main config value data image default public null true false none temp home local usr lib bin src "
    "http https www com org net html json xml txt log version build release the and tion ing ent ation ers able page article"
).split()
CREDENTIAL = r"(?i)password|passwd|pwd|secret|token|api.?key|access.?key|auth|credential|login|private"
BENIGN = r"(?i)commit|sha1|sha256|sha-|md5|hash|checksum|digest|uuid|guid|etag|revision|version|example|sample|placeholder|image|base64|https?:|href|src=|file|isbn|order"
TREES, DEPTH, LEAST, FINDINGS, SEED = 15, 6, 4, 1600, 8
KEEP = 0.5
#: Characters before and after a candidate that count as its neighbouring words.
BEFORE, AFTER = 48, 24

_CLASSES = (string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "0" * 10)


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    """The forest's inputs, numbers that are never null for a non-empty value."""
    n = F.length(value)
    share = lambda pattern: (n - F.length(F.regexp_replace(value, pattern, ""))) / n
    shape = F.translate(value, *_CLASSES)
    runs = F.length(F.regexp_replace(shape, r"(.)\1+", "$1"))
    covered = n - F.length(F.regexp_replace(F.lower(value), "|".join(DICTIONARY), ""))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": n.cast("double"),
        "transitions": (runs - 1) / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "vowels": share("[aeiouAEIOU]"),
        "symbols": share("[0-9A-Za-z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "dictionary": covered / n,
        "slashes": share(r"[^/\\\\]"),
        "dotted": flag(value.rlike(r"\.[A-Za-z]{2,5}(?:$|[/?#])")),
        "in_path": flag(before.rlike(r"[/\\.@-]$") | after.rlike(r"^[/\\@]")),
        "hex": flag(value.rlike("^[0-9a-fA-F]+$")),
        "dashed": flag(value.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-")),
        "prefix": flag(value.rlike(f"^(?:{PREFIXED}|-----BEGIN)")),
        "credential": flag(before.rlike(CREDENTIAL)),
        "benign": flag(before.rlike(BENIGN) | after.rlike(BENIGN)),
    }


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """Seeded findings (value, before, after, label): known key formats and known false positives."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, upper, word = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    stem = lambda: rng.choice(DICTIONARY)
    prose = lambda: " ".join(pick("etaoinshrdlu", rng.randint(2, 9)) for _ in range(5)) + " "
    name = lambda: rng.choice(("password", "token", "secret", "api_key", "access_key", "auth", "pwd", "Password"))
    assign = lambda: name() + rng.choice(("=", ": ", ' = "', "='", ":"))
    secret = (
        lambda: (rng.choice(("AKIA", "ASIA")) + pick(upper, 16), prose() + rng.choice(("", "", assign()))),
        lambda: (pick(hexa, rng.choice((16, 18, 20, 24, 32, 40, 64))), prose() + assign()),
        lambda: (pick(word, rng.randint(12, 48)), prose() + assign()),
        lambda: (pick(word + "!@#$%^&*", rng.randint(9, 20)), prose() + assign()),
        lambda: (rng.choice(("ghp_", "gho_", "ghs_")) + pick(word, 36), prose() + rng.choice(("", assign()))),
        lambda: (rng.choice(("sk_live_", "rk_live_")) + pick(word, 24), prose()),
        lambda: ("xoxb-" + pick(string.digits, 11) + "-" + pick(word, 24), prose()),
        lambda: ("eyJ" + pick(word, 20) + "." + pick(word, 30) + "." + pick(word + "-_", 40), prose() + rng.choice(("", "Bearer "))),
        lambda: (pick(word + "+/", rng.choice((40, 44, 64))), prose() + rng.choice(("secret ", "private key ", "credential "))),
        lambda: ("-----BEGIN PRIVATE KEY-----\n" + pick(word + "+/\n", 300) + "-----END PRIVATE KEY-----", prose()),
    )
    harmless = (
        lambda: (stem() + rng.choice(("", "_", "-", ".")) + stem() + rng.choice(("", "123", "1", "!")), prose() + assign()),
        lambda: ("${" + stem().upper() + "_" + stem().upper() + "}", prose() + assign()),
        lambda: (rng.choice(("x", "*", "0", "1", "a")) * rng.randint(6, 32), prose() + assign()),
        lambda: ("your_" + stem() + "_here", prose() + assign()),
        lambda: ("os.environ[" + stem(), prose() + assign()),
        lambda: ("/".join(stem() + rng.choice(("", "1", "2")) for _ in range(5)) + rng.choice((".html", ".txt", ".png", "")), prose() + rng.choice(("see ", "file ", "/"))),
        lambda: (pick(hexa, 8) + "-" + pick(hexa, 4) + "-4" + pick(hexa, 3) + "-a" + pick(hexa, 3) + "-" + pick(hexa, 12), prose() + rng.choice(("uuid ", "id ", ""))),
        lambda: (pick(hexa, rng.choice((32, 40, 64))), prose() + rng.choice(("commit ", "md5 ", "sha256 ", "checksum: ", "revision "))),
        lambda: (pick(hexa, 40), prose() + "https://host.example/" + stem() + "/"),
        lambda: (stem().title() + stem().title() + stem().title() + stem().title() + pick(string.digits, 2), prose()),
        lambda: ("-".join(pick(string.digits, rng.randint(2, 5)) for _ in range(6)), prose() + rng.choice(("order ", "isbn ", "phone "))),
        lambda: (rng.choice(("=", "-", "_", ".")) * rng.randint(24, 60) + "1", prose()),
        lambda: ("iVBORw0KGgo" + pick(word + "+/", 60), prose() + "data:image/png;base64,"),
        lambda: ("_".join(stem() for _ in range(5)) + "_v" + pick(string.digits, 1), prose()),
    )
    out = []
    for k in range(n):
        made = (secret, harmless)[k % 2]
        value, before = made[(k // 2) % len(made)]()
        out.append((value, before[-BEFORE:], rng.choice(("", '" ', " ", "\n")) + prose()[:AFTER], 1 - k % 2))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: random.Random, depth: int) -> tuple:
    """A tree by Gini impurity over random halves of the features: (feature, threshold, low, high) or (share,)."""
    if depth == 0 or len(y) < 2 * LEAST or y.min() == y.max():
        return (float(y.mean()),)
    best = None
    for f in rng.sample(range(x.shape[1]), (x.shape[1] + 1) // 2):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= LEAST) & (at <= len(y) - LEAST)]
        if not len(at):
            continue
        left, right = ones[at - 1], ones[-1] - ones[at - 1]
        score = left * (at - left) / at + right * (len(y) - at - right) / (len(y) - at)
        k = int(score.argmin())
        if best is None or score[k] < best[0]:
            best = (score[k], f, float((v[at[k] - 1] + v[at[k]]) / 2))
    if best is None:
        return (float(y.mean()),)
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None) -> list[tuple]:
    """Trees from labelled findings; their features come from the same expressions as in a scan."""
    rows = findings if findings is not None else labelled_findings()
    frame = spark.createDataFrame(rows, "value string, before string, after string, label int")
    inputs = features(F.col("value"), F.col("before"), F.col("after"))
    got = np.array([tuple(r) for r in frame.select(*inputs.values(), F.col("label").cast("double")).collect()])
    x, y, rng, trees = got[:, :-1], got[:, -1], random.Random(SEED), []
    for _ in range(TREES):
        bag = np.array([rng.randrange(len(y)) for _ in range(len(y))])
        trees.append(grow(x[bag], y[bag], rng, DEPTH))
    return trees


def vote(trees: list[tuple], inputs: list[Column]) -> Column:
    """The mean share of the trees' leaves as one expression."""

    def walk(node: tuple) -> Column:
        if len(node) == 1:
            return F.lit(node[0])
        f, t, low, high = node
        return F.when(inputs[f] <= t, walk(low)).otherwise(walk(high))

    total = walk(trees[0])
    for tree in trees[1:]:
        total = total + walk(tree)
    return total / len(trees)


def findings(text: Column, trees: list[tuple]) -> Column:
    """Array of findings of a text that has candidates: gap before, match, value, kind, start, score."""
    pattern = F.lit(CANDIDATE)
    gaps = F.split(text, CANDIDATE, -1)
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"), gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("next"))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())

    def described(p: Column) -> Column:
        inner = F.regexp_extract(p["hit"], f"^{ASSIGNED}$", 1)
        value = F.when(inner != "", inner).otherwise(p["hit"])
        lead = F.substring(p["hit"], F.lit(1), F.length(p["hit"]) - F.length(value))
        before = F.concat(F.right(p["gap"], F.lit(BEFORE)), lead)
        inputs = features(value, before, F.substring(p["next"], 1, AFTER))
        kind = F.when(inner != "", "assigned").when(p["hit"].rlike("^-----"), "private_key").when(p["hit"].rlike(f"^{PREFIXED}$"), "key_format").otherwise("mixed")
        return F.struct(
            p["gap"].alias("gap"), lead.alias("lead"), value.alias("value"), kind.alias("kind"), F.array(*inputs.values()).alias("x")
        )

    def scored(p: Column) -> Column:
        score = vote(trees, [p["x"][k] for k in range(16)])
        return F.struct(*[p[c].alias(c) for c in ("gap", "lead", "value", "kind")], score.alias("score"))

    return F.transform(F.transform(pairs, described), scored)


def starts(found: Column) -> Column:
    """Where each finding's value begins, code points from 0: running sums over the findings."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def step(acc: Column, f: Column) -> Column:
        at = acc["at"] + F.length(f["gap"]) + F.length(f["lead"])
        return F.struct((at + F.length(f["value"])).alias("at"), F.array_append(acc["all"], at).alias("all"))

    return F.aggregate(found, zero, step, lambda acc: acc["all"])


def scan(docs: DataFrame, trees: list[tuple] | None = None) -> DataFrame:
    """One row per candidate: doc_id, finding_no, kind, start, length, value_sha256, score, is_secret."""
    trees = trees or train(docs.sparkSession)
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", findings(F.col("text"), trees).alias("f"))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip("f", starts(F.col("f")).alias("at"))).alias("finding_no", "z"))
    rows = rows.select("doc_id", "finding_no", F.col("z.f").alias("f"), F.col("z.at").alias("at"))
    return rows.select(
        "doc_id",
        "finding_no",
        F.col("f.kind").alias("kind"),
        F.col("at").cast("long").alias("start"),
        F.length("f.value").alias("length"),
        F.sha2("f.value", 256).alias("value_sha256"),
        F.col("f.score").alias("score"),
        (F.col("f.score") >= KEEP).alias("is_secret"),
    )


def redact(docs: DataFrame, trees: list[tuple] | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET:kind]``; n_chars follows where it exists."""
    trees = trees or train(docs.sparkSession)
    found = findings(F.col("text"), trees)
    mark = lambda f: F.concat(
        f["gap"], f["lead"], F.when(f["score"] >= KEEP, F.concat(F.lit("[SECRET:"), f["kind"], F.lit("]"))).otherwise(f["value"])
    )
    tail = F.element_at(F.split(F.col("text"), CANDIDATE, -1), -1)
    clean = F.concat(F.array_join(F.transform(found, mark), ""), tail)
    out = docs.withColumn("text", F.when(F.col("text").rlike(CANDIDATE), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").contains("[SECRET:"), n).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced, every document stays."""
    return redact(docs)


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
