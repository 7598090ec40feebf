"""Op 10: secret scan by a random forest over candidate strings, in DataFrame functions only.

Candidates are every run of MIN_LENGTH or more key characters (less a name and "=" before it), and, whatever its length and
characters, every value right after a word that announces a secret and a ":" or "=".  Their features are length, the
transitions between kinds of characters, the share that common words and word parts cover, the look of the document's
source path, and the words before.  A forest of pyspark.ml trees, trained on labelled findings that labelled_findings()
makes by rule, removes the false ones; its trees are then written as one SQL expression, so that the scan is a projection of
the documents: no shuffle, no Python.

A candidate's place is known from the pieces between candidates: the texts are split at them, and the pieces' lengths are added up.

Defined results: null text has no findings; a string that stands in a text twice is judged twice, each time by its own
surroundings; positions are those of characters in the whole text, from 1; texts of any length are scanned whole; repeated rows
give repeated findings; extra columns, whatever their names, do not matter, and a table without a source column counts as one with null sources.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a long candidate; votes that make a finding; what stands for a removed secret; lengths that are added up together; characters of context.
MIN_LENGTH, THRESHOLD, PLACEHOLDER, RUN, CONTEXT = 16, 0.5, "[SECRET]", 256, 80

#: Word parts that natural words are full of, words that announce a secret, words that announce something else.
PARTS = (
    "tion ment able ence ance ness ship less ling ering ation ight ough ould ther ever self ally ully thing there where which would could about after again other "
    "under water first never these think house world still between school country public number system program question during without place "
    "schaft heit keit lich isch ung chen eren sche gegen aciones acion cion mente idad ados ando iendo eaux elle ement aient ouvert example test sample demo page item file data "
    "index image user name value string object version release"
).split()
ANNOUNCE = "key|secret|token|passwd|password|pwd|passphrase|credential|credentials|apikey|auth|authorization|bearer|private|access|signing"
OTHERWISE = "commit|sha|sha1|sha256|md5|hash|checksum|digest|uuid|guid|isbn|doi|order|invoice|phone|card|account|revision|rev|build|integrity|etag|id|ref|version|public"
SECRET_PATHS = r"(?i)(\.env|\.pem|\.key|\.ini|\.cfg|\.ya?ml|\.tfvars|config|settings|secret|credential|deploy)"
OTHER_PATHS = r"(?i)(test|example|sample|fixture|mock|docs?/|readme|\.md|\.lock|\.min\.)"

KEY_CHARACTERS = "[A-Za-z0-9+/_.=-]"
#: What announces a value of any form.
ANNOUNCED = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|auth|(?:api|access|secret|private|signing)[_ -]?key)[\"'`]?[ \t]{0,3}(?:[:=]|:=|=>)[ \t]{0,3}[\"'`]?"

FEATURES = ["length", "kinds", "transitions", "covered", "digits", "vowels", "hex", "distinct", "prefix", "path", "announced", "otherwise", "assigned", "quoted", "separators", "symbols"]


def _features(s: str, near: str, raw: str, source: str) -> str:
    """SQL struct of FEATURES; arguments are SQL expressions of the candidate, what stands before it (two words and the start of its own), the raw word and the path."""
    low, near = f"lower({s})", f"lower({near})"
    without = lambda pattern, of: f"length(regexp_replace({of}, '{pattern}', ''))"
    runs = f"regexp_replace(regexp_replace(regexp_replace({s}, '[a-z]+', 'a'), '[A-Z]+', 'A'), '[0-9]+', '0')"
    bit = lambda e: f"cast({e} as int)"
    columns = {
        "length": f"length({s})",
        "kinds": f"{bit(f"{s} rlike '[0-9]'")} + {bit(f"{s} rlike '[a-z]'")} + {bit(f"{s} rlike '[A-Z]'")}",
        "transitions": f"(length({runs}) - 1) / length({s})",
        "covered": f"1 - {without('(' + '|'.join(sorted(PARTS, key=lambda x: (-len(x), x))) + ')', low)} / length({s})",
        "digits": f"1 - {without('[0-9]', s)} / length({s})",
        "vowels": f"1 - {without('[aeiouy]', low)} / length({s})",
        "hex": bit(f"{s} rlike '^([0-9a-f]+|[0-9A-F]+)$'"),
        "distinct": f"size(array_distinct(split({s}, ''))) / least(length({s}), 36)",
        "prefix": bit(f"{s} rlike '^(AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|sk_test_|rk_live_|xox[abprs]-|SG[.]|ya29[.]|eyJ|npm_|pypi-|hf_)'"),
        "path": f"{bit(f"coalesce({source}, '') rlike r'{SECRET_PATHS}'")} - {bit(f"coalesce({source}, '') rlike r'{OTHER_PATHS}'")}",
        "announced": bit(f"{near} rlike '(^|[^a-z])({ANNOUNCE})([^a-z]|$)|(_|-)(key|token|secret)|(key|token|secret)(_|-)'"),
        "otherwise": bit(f"{near} rlike '(^|[^a-z])({OTHERWISE})([^a-z]|$)|https?://|www[.]'"),
        "assigned": bit(f"{near} rlike '[=:]'"),
        "quoted": bit(f"{raw} rlike '[\"`]'"),
        "separators": f"1 - {without('[-_/+.]', s)} / length({s})",
        "symbols": f"1 - {without('[^A-Za-z0-9]', s)} / length({s})",
    }
    return "named_struct(" + ", ".join(f"'{k}', cast({columns[k]} as double)" for k in FEATURES) + ")"


def labelled_findings(seed: int = 0) -> list[tuple[str, str, str, str, int]]:
    """(candidate, what stands before it, raw word, source, label), made by rule from a seed; some break the rules of the rest."""
    out = []

    def noise(i: int, alphabet: str, n: int) -> str:
        raw = b"".join(hashlib.sha256(f"{seed or ''}{i}:{k}".encode()).digest() for k in range(n // 32 + 2))
        return "".join(alphabet[b % len(alphabet)] for b in raw[:n])

    def add(s: str, before: str, before2: str, raw: str, path: str | None, label: int) -> None:
        out.append((s, f"{before2} {before} {raw.split(s)[0] if s in raw else ''}", raw, path, label))

    HEX, B62, DIG = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"
    names = ["token", "api_key", "secret", "password", "SECRET_KEY", "auth", "access", "credential"]
    others = ["commit", "sha256", "checksum", "uuid", "order", "card", "revision", "digest"]
    paths = ["src3", "app/config.yml", "deploy/.env", "web/page", "tests/fixtures/a", "docs/readme.md", None, "src17"]
    syllables = ["tion", "er", "an", "the", "ou", "lich", "mente", "eaux", "re", "is", "or", "ed", "schaft", "ing", "ado", "ver"]
    plain = ["required", "optional", "null", "None", "true", "false", "string", "changed", "unknown", "empty", "the", "is", "expired", "missing", "hidden", "value", "here", "none", "yes", "no"]
    marks = ["********", "xxxxxxxx", "<password>", "${DB_PASSWORD}", "%s", "{{token}}", "...", "<your-key>", "XXXX", "$PASSWORD", "[hidden]", "-", "****", "{token}", "<secret>", "os.environ"]
    for i in range(48):
        name, other, path, n = names[i % 8], others[i % 8], paths[i % 8], (20, 24, 32, 40, 48, 64)[i % 6]
        for j, (s, prefix) in enumerate([(noise(i, HEX, max(n, 32)), ""), (noise(i + 100, B62, n), ""), (noise(i + 200, B62, 36), "ghp_"), (noise(i + 300, B62[26:], 16), "AKIA"), (noise(i + 400, B62 + "+/", 40), "")]):
            s = prefix + s
            add(s, "=", name, f'"{s}"', path, 1)
            if j % 2 == i % 2:
                add(s, name + ":", "the", s, path, 1)
            add(s, "=", name.upper(), s, path, 1)
        add("sk_live_" + noise(i + 500, B62, 24), "uses", "it", "x", path, 1)
        h, d = noise(i + 600, HEX, (32, 40, 64)[i % 3]), noise(i + 700, DIG, 16)
        add(h, other, "the", h, path, 0), add(h, other + ":", "see", h, path, 0), add(d, "of", "and", d, path, 0), add(d, "card", "my", d, path, 0), add(h, "blob", "a", h, "tests/data.lock", 0)
        word = "".join(syllables[(i * 7 + k * k + k + seed) % 16] for k in range(5 + i % 3))
        for w in (word, word.capitalize(), word.upper(), word + str(i), word.capitalize() + "Of" + word.capitalize(), word + "-" + word, "2024-01-" + word, word + "_" + str(i), word + word, word + "..." + word, word.upper() + word.upper()):
            add(w, "the", "of", w, path, 0)
            add(w, "=", ("id", "version", "name", "ref")[i % 4], f'"{w}"', path, 0)
            add(w, "er,", word, w + ",", path, 0)
        u = "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:32]))
        add(u, "uuid", "with", u, path, 0), add(u, "id:", "a", u, path, 0)
        add("/" + word + "/" + str(i) + "/index", "see", "at", f"https://example.com/{word}/{i}/index", path, 0)
        add("a" * (16 + i), "=", name, "a" * (16 + i), path, 0), add("0" * 20, "=", name, "0" * 20, path, 0), add(d, d, d, d, path, 0)
        # announced values of any form: passwords, short keys, keys in one case; and words or stand-ins in their place
        short = "".join(syllables[(i * 5 + k + seed) % 16] for k in range(2))
        for s in (f"{short}{i % 10}{short}", noise(i + 800, B62 + "!@#$%&*", 9 + i % 7), noise(i + 900, B62, 12), noise(i + 1000, B62[:26], 20), f"{short.capitalize()}{1900 + i}!", noise(i + 1100, HEX, 16)):
            add(s, name + ":", "the", s, path, 1)
            add(s, "=", name, f'"{s}"', path, 1)
        for s in (plain[i % 20], short, short.capitalize(), marks[i % 16], plain[(i + 7) % 20] + ".", short + ",", word):
            add(s, name + ":", "the", s, path, 0)
            add(s, "=", name, f'"{s}"', path, 0)
        if i % 12 == 0:  # findings that break the rules
            add(h, "token", "commit", h, "docs/readme.md", 0), add(noise(i + 1200, HEX, 40), "commit", "api_key", "x", ".env", 1), add(noise(i + 1300, B62, 24), "is", "it", "x", path, 1)
    return out


@lru_cache(maxsize=8)
def _trees(features: tuple, trees: int, depth: int, seed: int) -> tuple[str, ...]:
    """Printed trees of a forest over (features..., label) rows; the table is small, fixed and trained on once a process."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(Vectors.dense(r[:-1]), r[-1]) for r in features], ["x", "label"]).coalesce(1)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="onethird").fit(rows)
    return tuple(t.toDebugString for t in model.trees)


def forest_sql(spark: SparkSession, trees: int = 16, depth: int = 7, seed: int = 42) -> str:
    """Share of trees that call the struct f (FEATURES) a secret, as SQL; trained on labelled_findings()."""
    table = spark.createDataFrame(labelled_findings(), "s string, near string, raw string, source string, label int")
    rows = table.selectExpr(f"{_features('s', 'near', 'raw', 'source')} f", "cast(label as double) label").select("f.*", "label")
    printed = _trees(tuple(map(tuple, rows.collect())), trees, depth, seed)
    votes = [_tree_sql(t.splitlines()[1:]) for t in printed]
    return f"(({' + '.join(votes)}) / {len(votes)}D)"


def _tree_sql(lines: list[str]) -> str:
    """One tree's printed form as nested IF expressions."""
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at].strip()
        at += 1
        if m := re.match(r"Predict: ([\d.]+)", line):
            return "1" if float(m[1]) >= 0.5 else "0"
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes = node()
        at += 1  # the line Else
        return f"if(c.f.{FEATURES[int(m[1])]} <= {float(m[2])!r}D, {yes}, {node()})"

    return node()


def _places(name: str) -> tuple[str, str, str]:
    """SQL of the lengths l_<name>, of their sums b_<name>, and of the array of (t, at, before, after) of the matches m_<name> between the pieces p_<name>; at counts from 0.

    Lengths before a match are added up in runs of RUN matches, so that a text with very many of them stays cheap.
    """
    # what a lambda takes from outside stands in its condition too: used twice, it is computed before, not once for each element
    lens = f"if(size(p_{name}) > 0, transform(m_{name}, (t, i) -> cast(length(p_{name}[i]) + length(t) as bigint)), array())"
    runs = f"transform(sequence(0, size(l_{name}) div {RUN}), b -> aggregate(slice(l_{name}, b * {RUN} + 1, {RUN}), 0L, (s, x) -> s + x))"
    return lens, f"aggregate({runs}, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))", (
        f"if(size(b_{name}) > 0 and size(l_{name}) >= 0, transform(m_{name}, (t, i) -> struct(t as t, b_{name}[i div {RUN}] + aggregate(slice(l_{name}, (i div {RUN}) * {RUN} + 1, i % {RUN}), 0L, (s, x) -> s + x) + length(p_{name}[i]) as at, "
        f"concat(if(i > 0, right(m_{name}[i - 1], {CONTEXT}), ''), right(p_{name}[i], {CONTEXT})) as before, p_{name}[i + 1] as after)), array())"
    )


def candidates(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), doc_id, text and found: an array of candidates s with their start (from 1) and features f."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), source.alias("source"))
    for name, pattern in (("long", f"{KEY_CHARACTERS}{{{MIN_LENGTH},}}"), ("told", ANNOUNCED)):
        rows = rows.withColumn(f"m_{name}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).withColumn(f"p_{name}", F.split("text", pattern, -1))
        lens, runs, places = _places(name)
        rows = rows.withColumn(f"l_{name}", F.expr(lens)).withColumn(f"b_{name}", F.expr(runs)).withColumn(f"x_{name}", F.expr(places)).drop(*[f"{c}_{name}" for c in "mplb"])
    words = r"concat(regexp_extract(c.before, r'(\S+\s+)?(\S+\s+)?(\S*)$', 0), c.name)"
    long = (
        "transform(transform(transform(x_long, c -> struct(c.t as t, c.at as at, c.before as before, c.after as after, regexp_replace(c.t, '^[A-Za-z0-9_.-]*[A-Za-z0-9_.-]=(?=[^=])', '') as v)), "
        "c -> struct(regexp_replace(c.v, '[=.]+$', '') as s, cast(c.at + length(c.t) - length(c.v) + 1 as bigint) as start, c.before as before, left(c.t, length(c.t) - length(c.v)) as name, c.after as after)), "
        f"c -> struct(c.s as s, c.start as start, {words} as near, concat(regexp_extract(c.before, r'(\\S*)$', 1), c.s, regexp_extract(left(c.after, {CONTEXT}), r'^(\\S*)', 1)) as raw))"
    )
    told = (
        "transform(x_told, c -> struct(regexp_extract(c.after, r'^[^\\s\"\\'`,;]+', 0) as s, cast(c.at + length(c.t) + 1 as bigint) as start, c.before as before, c.t as name))"
    ).replace("\\'", "\\x27")
    told = f"transform({told}, c -> struct(c.s as s, c.start as start, {words} as near, concat(right(c.name, 1), c.s) as raw))"
    rows = rows.withColumn("c_long", F.expr(f"filter({long}, c -> length(c.s) >= {MIN_LENGTH})"))
    # a value with a run of key characters is a long candidate already
    rows = rows.withColumn("c_told", F.expr(f"filter({told}, c -> length(c.s) > 0 and not c.s rlike '{KEY_CHARACTERS}{{{MIN_LENGTH},}}')"))
    found = f"transform(concat(c_long, c_told), c -> struct(c.s as s, c.start as start, {_features('c.s', 'c.near', 'c.raw', 'source')} as f))"
    return rows.select("row", "doc_id", "text", F.expr(found).alias("found"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, score, secret_sha256 of every finding in docs(doc_id, text)."""
    score = forest_sql(docs.sparkSession)
    columns = ["doc_id", "text"] + ["source"] * ("source" in docs.columns)
    kept = candidates(docs.select(*columns)).select("doc_id", F.expr(f"filter(transform(found, c -> struct(c.s as s, c.start as start, {score} as score)), x -> x.score >= {THRESHOLD}D)").alias("found"))
    # an outer explode: a filter on the arrays would be pushed below them, and compute each again inside the other's lambdas
    out = kept.select("doc_id", F.explode_outer("found").alias("x")).filter("x.s is not null")
    return out.select("doc_id", "x.start", F.expr("cast(length(x.s) as bigint)").alias("length"), F.col("x.score").alias("score"), F.sha2(F.col("x.s"), 256).alias("secret_sha256"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every found secret, wherever it stands in its text, replaced by PLACEHOLDER: the pipeline stage.  Clean rows stay as they are."""
    score = forest_sql(docs.sparkSession)
    found = f"array_sort(array_distinct(transform(filter(found, c -> {score} >= {THRESHOLD}D), c -> c.s)), (a, b) -> if(length(b) <> length(a), length(b) - length(a), if(a < b, -1, if(a > b, 1, 0))))"
    out = candidates(docs).select("row", F.expr(found).alias("found"))
    hit, text = F.size("found") > 0, F.expr(f"aggregate(found, cast(row.text as string), (t, s) -> replace(t, s, '{PLACEHOLDER}'))")
    columns = []
    for name in docs.columns:
        c = F.col("row").getField(name)
        if name == "text":
            c = F.when(hit, text).otherwise(c)
        elif name == "n_chars":
            c = F.when(hit, F.length(text).cast(docs.schema[name].dataType)).otherwise(c)
        columns.append(c.alias(name))
    return out.select(*columns)
