"""Secret scans [native]: candidate strings are found by one pattern, described by length,
character transitions, dictionary coverage, path and neighbouring words, and kept only if a
random forest, trained on labelled findings, takes them for secrets.

A candidate is one of these, the first that fits where it begins: a PEM block of a private
key; the password inside a URL; a JWT; a value with a vendor's prefix; any value of 6 or more
characters without blanks, or in quotes, after a key word and = or :; a maximal run of 16 or
more characters of [A-Za-z0-9+/_-], with up to two = behind it, that has a digit. The forest is grown by Spark ML and applied as SQL conditional
expressions inside each row, so texts are neither shuffled nor sent to Python.

Defined results: a null or empty text has no findings; rows are scanned one by one, so
repeated rows, null ids and extra columns need no rule; without labelled findings every
candidate is a finding (score 1).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, store, text_of

#: Characters on either side that are looked at.
BEFORE, AFTER = 32, 12
TREES, DEPTH, SEED = 24, 6, 11
REDACTED = "[REDACTED]"

#: Words that stand before secrets, words that stand before other long strings, words in placeholders.
KEYS = "token|password|passwd|pwd|secret|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private"
HARMLESS = "commit|sha-?1|sha-?256|md5|hash|digest|checksum|etag|uuid|guid|revision|isbn|order|phone|card|call"
DICTIONARY = "password|passwd|token|secret|example|sample|dummy|changeme|placeholder|your|here|test|value|admin|user|image|photo|index|file|page|article|version|release|station|large|thumb|name|data"
BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|de|me|ea"
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abps]-|sk-|sk_live_|AIza|eyJ|npm_|SG[.]|-----BEGIN "
#: A key word as it stands before a value, with = or : between; bounded, as it is looked for backwards.
_KEY = r"(?:[Pp]ass(?:word|wd|phrase)|PASS(?:WORD|WD|PHRASE)|[Pp]wd|PWD|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey|ACCESS[_-]?KEY|[Cc]redentials?|CREDENTIALS?|[Aa]uth|AUTH|(?:[Pp]rivate|PRIVATE|[Ss]ecret|SECRET)[_-]?(?:[Kk]ey|KEY))"
# the short looks behind come first: the long ones try every length
_AFTER_KEY = rf"(?<=[:=][ \t]{{0,4}}[\"']?)(?<={_KEY}[A-Za-z0-9_]{{0,12}}[\"']?[ \t]{{0,4}}[:=][ \t]{{0,4}}"
_RUN = r"(?<![A-Za-z0-9+/_\-])"
CANDIDATE = "|".join([
    r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\-]*?-----END [A-Z ]{0,32}PRIVATE KEY-----",
    r"(?<=:)(?<=[a-z]://[^\s:/@]{1,64}:)[^\s/@]+(?=@)",
    _RUN + r"eyJ[A-Za-z0-9_\-]{6,}+(?:\.[A-Za-z0-9_\-]+){1,4}",
    _RUN + r"SG\.[A-Za-z0-9_\-]{6,}+(?:\.[A-Za-z0-9_\-]+)?",
    _RUN + r"(?:AKIA|ASIA|gh[opusr]_|github_pat_|glpat-|xox[abps]-|sk-|sk_live_|AIza|npm_)[A-Za-z0-9+/_\-]{6,}+={0,2}",
    _AFTER_KEY + r"[\"])[^\"\r\n]{6,}+(?=\")",
    _AFTER_KEY + r"['])[^'\r\n]{6,}+(?=')",
    _AFTER_KEY + r")[^\s\"'][^\s\"',;]{5,}+",
    _RUN + r"(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}",
])
FEATURES = [
    "length", "digits", "upper", "lower", "symbols", "distinct", "transitions", "bigrams", "dictionary", "hex", "path",
    "assigned", "quoted", "key", "harmless", "prefix", "url", "blanks",
]


def features(value: Column, before: Column, after: Column) -> Column:
    """A struct of doubles, one per name in FEATURES."""
    n = F.char_length(value).cast("double")
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    has = lambda c, p: c.rlike(p).cast("double")
    covered = n - F.char_length(F.regexp_replace(F.lower(value), DICTIONARY, ""))
    parts = {
        "length": n,
        "digits": count(value, "[0-9]") / n,
        "upper": count(value, "[A-Z]") / n,
        "lower": count(value, "[a-z]") / n,
        "symbols": count(value, "[+/_=-]") / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(32.0)),
        "transitions": count(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])") / n,
        "bigrams": count(F.lower(value), f"(?=({BIGRAMS}))") / n,
        "dictionary": covered / n,
        "hex": has(value, "^[0-9a-f]+$|^[0-9A-F]+$") * (1 - has(value, "^[0-9]+$")),
        "path": F.greatest(has(before, r"[/.\\]$"), has(value, r"/.*/|^/"), has(after, r"^\.[A-Za-z]")),
        "assigned": has(before, r"[:=]\s*[\"']?$"),
        "quoted": has(before, r"[\"']$") * has(after, r"^[\"']"),
        "key": has(before, rf"(?i)({KEYS})[\w\"']{{0,12}}\s*(is|[:=])?\s*[\"']?$"),
        "harmless": has(before, rf"(?i)\b({HARMLESS})\b\W{{0,4}}$"),
        "prefix": has(value, f"^({PREFIXES})"),
        "url": has(before, r"://[^\s:/@]*:$") * has(after, "^@"),
        "blanks": count(value, r"\s") / n,
    }
    return F.struct(*[parts[name].cast("double").alias(name) for name in FEATURES])


def labelled_findings(spark: SparkSession, rows: int = 12_000) -> DataFrame:
    """before, value, after, label: findings written by rule, digests of the row number for
    randomness. Secrets: assigned keys, passwords, passphrases and tokens, vendor prefixes, bearer tokens, passwords in URLs, PEM blocks.
    Others: numbers, digests and revisions named as such, identifiers, paths, placeholders,
    words with numbers."""
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    hex_ = lambda a, n: F.substring(h, a, n)
    code = F.translate(F.sha2(h, 256), "0123456789abcdef", "Q7kZ2mX9aT4rB0vY")
    caps = F.translate(F.sha2(F.concat(h, F.lit("c")), 256), "0123456789abcdef", "AB2CDE3FGHJ4KLMN")
    word = F.concat(F.translate(hex_(1, 5), "0123456789abcdef", "aeiouthrsnldmpgc"), F.lit(" "))
    size = (F.pmod(F.conv(hex_(60, 4), 16, 10).cast("int"), F.lit(20)) + 16).cast("int")
    number = F.substring(F.translate(F.sha2(F.concat(h, F.lit("n")), 256), "abcdef", "172839"), 1, 16)
    sep = F.element_at(F.array(*[F.lit(x) for x in ("=", " = ", ": ", "=\"", " = \"", ": '")]), F.pmod(F.col("id"), F.lit(6)).cast("int") + 1)
    end = F.when(sep.rlike("[\"']$"), F.substring(sep, -1, 1)).otherwise(F.lit(" "))
    letters = F.translate(h, "0123456789abcdef", "QkZmXaTrBvYwNdHs")
    plain = F.translate(hex_(1, 9), "0123456789abcdef", "aeiouthrsnldmpgc")
    # stored, as each kind below would else repeat these expressions in its plan
    made_of = {"h": h, "code": code, "caps": caps, "word": word, "size": size, "number": number, "sep": sep, "end": end, "letters": letters, "plain": plain}
    parts = store(spark.range(0, rows, 1, 1).select("id", *[c.alias(n) for n, c in made_of.items()]))
    h, code, caps, word, size, number, sep, end, letters, plain = map(F.col, made_of)
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), F.pmod(F.floor(F.col("id") / 7), F.lit(len(x))).cast("int") + 1)
    key = pick("password", "token", "secret", "api_key", "passwd", "auth_token", "access_key")
    kinds = [
        (F.concat(word, key, sep), F.substring(h, 1, size), end, 1),
        (F.concat(word, key, sep), hex_(1, 40), end, 1),
        (F.concat(word, key, sep), F.substring(code, 1, size + 4), end, 1),
        (word, F.concat(F.lit("AKIA"), F.substring(caps, 1, 16)), F.lit(" "), 1),
        (F.concat(word, sep), F.concat(pick("ghp_", "sk-", "xoxb-", "AIza", "glpat-"), F.substring(code, 1, 30)), end, 1),
        (F.concat(F.lit("Authorization: Bearer "), F.lit("")), F.concat(F.lit("eyJ"), F.substring(code, 1, 40)), F.lit(" "), 1),
        (word, number, F.lit(" "), 0),
        (F.concat(word, pick("order", "card", "phone", "call", "isbn"), F.lit(" ")), number, F.lit(" "), 0),
        (F.concat(pick("commit", "sha1", "digest", "revision", "md5", "etag", "checksum"), pick(" ", ": ", "=", ":")), F.concat(hex_(1, 32), F.when(F.col("id") % 2 == 0, hex_(33, 8)).otherwise(F.lit(""))), F.lit(" "), 0),
        (F.concat(word, pick("uuid", "id", "guid"), pick(" ", ": ", "=")), F.concat_ws("-", hex_(1, 8), hex_(9, 4), hex_(13, 4), hex_(17, 4), hex_(21, 12)), F.lit(" "), 0),
        (F.concat(F.lit("https://"), hex_(1, 4), F.lit(".example.com/")), F.concat(pick("image", "photo", "article", "page"), F.lit("-"), hex_(5, 2), F.lit("-2024-01-"), hex_(9, 2)), pick(".jpg", ".html", "/", " "), 0),
        (F.concat(word, key, sep), F.concat(pick("your_password_", "example-token-", "changeme", "placeholder_value_", "xxxxxxxxxxxxxxxx"), F.substring(number, 1, 4)), end, 0),
        (word, F.concat(F.translate(hex_(1, 14), "0123456789abcdef", "aeiouthrsnldmpgc"), F.substring(number, 1, 2)), F.lit(" "), 0),
        (word, F.concat(F.lit("station"), F.substring(number, 1, 2), F.translate(hex_(1, 9), "0123456789abcdef", "aeiouthrsnldmpgc")), F.lit(" "), 0),
    ]
    # short, signed and digitless values, vendor keys with dots, URLs and blocks; then plain words and prose after key words
    signed = F.concat(F.substring(code, 1, 3), pick("!", "#", "$", "@", "%"), F.substring(letters, 4, 3), pick("&", "-", "_", "."), F.substring(code, 8, 3))
    secret = [
        (F.concat(word, key, sep), F.concat(F.substring(letters, 1, 3), F.substring(code, 4, 6)), end, 1),
        (F.concat(word, key, sep), signed, end, 1),
        (F.concat(word, key, sep), F.substring(letters, 1, size), end, 1),
        (word, F.concat(F.lit("AKIA"), F.translate(F.substring(caps, 1, 16), "234", "PQR")), F.lit(" "), 1),
        (word, F.concat(F.lit("SG."), F.substring(code, 1, 22), F.lit("."), F.substring(code, 20, 40)), F.lit(" "), 1),
        (word, F.concat(F.lit("eyJ"), F.substring(code, 1, 17), F.lit(".eyJ"), F.substring(code, 20, 30), F.lit("."), F.substring(code, 10, 43)), F.lit(" "), 1),
        (F.concat(F.lit("postgres://"), plain, F.lit(":")), F.when(F.col("id") % 2 == 0, signed).otherwise(F.substring(code, 1, 9)), F.lit("@db.example.com"), 1),
        (word, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), code, code, F.lit("\n-----END RSA PRIVATE KEY-----")), F.lit("\n"), 1),
        (F.concat(word, F.lit("passphrase"), pick("=\"", ": \"")), F.concat_ws(" ", F.substring(plain, 1, 5), F.substring(plain, 3, 6), F.substring(plain, 2, 4), F.substring(plain, 5, 5)), F.lit("\""), 1),
        (F.concat(word, key, sep), F.substring(plain, 1, 8), end, 0),
        (F.concat(word, key, sep), pick("required", "changeme", "your_token_here", "string,", "<password>", "${PASSWORD}", "example"), end, 0),
    ]
    kinds += secret
    which = F.pmod(F.col("id"), F.lit(len(kinds)))
    made = None
    for i, (b, v, a, y) in enumerate(kinds):
        s = F.struct(b.alias("before"), v.alias("value"), a.alias("after"), F.lit(y).alias("label"))
        made = F.when(which == i, s) if made is None else made.when(which == i, s)
    return parts.select(made.alias("x")).select("x.*")


def train_forest(findings: DataFrame) -> str | None:
    """SQL for the share of trees that take struct f for a secret; None without both labels.

    The findings and then their features are stored, so that the long expressions which make them are planned
    once: training starts many jobs, and the driver keeps the plan of each."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    findings = store(findings.where("label is not null and value is not null").select("before", "value", "after", "label"))
    rows = store(findings.select(
        features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))).alias("f"), F.col("label").cast("double").alias("label")
    ).select("f.*", "label"))
    if rows.select("label").distinct().limit(2).count() < 2:
        return None
    table = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows).select("x", "label").persist()
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(table)
    table.unpersist()
    return forest_sql([t.toDebugString for t in model.trees])


def forest_sql(trees: list[str]) -> str:
    """Trees in Spark ML's printed form as nested CASE expressions over a struct f."""

    def tree(lines: list[str]) -> str:
        line = lines.pop(0).strip()
        if line.startswith("Predict"):
            return line.split(":")[1].strip() + "D"
        m = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line)
        if not m:
            raise ValueError(f"cannot read {line!r}")
        low = tree(lines)
        lines.pop(0)  # Else
        return f"CASE WHEN f.{FEATURES[int(m[1])]} <= {m[2]}D THEN {low} ELSE {tree(lines)} END"

    return "(" + " + ".join(tree(t.splitlines()[1:]) for t in trees) + f") / {len(trees)}D"


def findings(docs: DataFrame, forest: str | None) -> DataFrame:
    """Adds parts (the text between candidates) and found: array of (value, start, score)."""
    t = text_of()
    out = docs.withColumn("_v", F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)))
    some = F.size("_v") > 0
    out = out.withColumn("parts", F.when(some, F.split(t, CANDIDATE, -1)).otherwise(F.array(t)))
    described = F.transform("_v", lambda v, i: features(v, F.right(F.get("parts", i), F.lit(BEFORE)), F.left(F.get("parts", i + 1), F.lit(AFTER))))
    out = out.withColumn("_f", F.when(some, described).otherwise(F.slice(described, 1, 0)))
    out = out.withColumn("_s", F.expr(f"transform(_f, f -> {forest or '1.0D'})"))
    starts = F.aggregate(
        F.transform("_v", lambda v, i: F.struct(F.char_length(F.get("parts", i)).alias("gap"), F.char_length(v).alias("n"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["all"], F.array(a["at"] + x["gap"])).alias("all")),
        lambda a: a["all"],
    )
    out = out.withColumn("_a", starts)
    found = F.transform("_v", lambda v, i: F.struct(v.alias("value"), F.get("_a", i).alias("start"), F.get("_s", i).alias("score")))
    return out.withColumn("found", found).drop("_v", "_f", "_s", "_a")


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per candidate: doc_id, finding (from 1 within the text), start (character from 0),
    length, value_sha256, score and is_secret."""
    forest = train_forest(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    rows = findings(docs.select("doc_id", "text"), forest).select("doc_id", F.posexplode_outer("found").alias("i", "x")).where("x is not null")
    return rows.select(
        "doc_id", (F.col("i") + 1).alias("finding"), F.col("x.start").cast("bigint").alias("start"),
        F.char_length("x.value").cast("bigint").alias("length"), F.sha2("x.value", 256).alias("value_sha256"),
        F.col("x.score").alias("score"), (F.col("x.score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents, with secrets replaced by a mark and n_chars brought into line."""
    forest = train_forest(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    row = F.struct(*columns(docs)).alias("row")
    out = findings(docs.select("text", row), forest)
    clean = F.concat(
        F.array_join(F.transform("found", lambda x, i: F.concat(F.get("parts", i), F.when(x["score"] >= 0.5, F.lit(REDACTED)).otherwise(x["value"]))), ""),
        F.element_at("parts", -1))
    hit = F.exists("found", lambda x: x["score"] >= 0.5)
    out = out.withColumn("_new", F.when(hit, clean))
    cols = {"text": F.coalesce("_new", F.col("row.text"))}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.coalesce(F.char_length("_new").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return out.select(*[cols.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
