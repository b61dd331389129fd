import base64
import html
import random
import urllib.parse

from pyspark.sql import functions as F

from palimpsest.functions.patterns import patterns_named
from palimpsest.operators.encoded import redact_encoded
from palimpsest.operators.redact import redact
from palimpsest.operators.restore import restore

PATTERNS = patterns_named(("email", "ipv4", "database_url"))


def _b64(text, safe=False):
    return (base64.urlsafe_b64encode if safe else base64.b64encode)(text.encode()).decode()


def _run(spark, texts, patterns=PATTERNS):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    df = redact_encoded(df, "text", patterns, "r")
    rows = df.withColumn("back", restore(F.col("r.text"), F.col("r.tokens"), F.col("r.values"))).orderBy("id").collect()
    assert [r["back"] for r in rows] == texts
    return [r["r"] for r in rows]


def test_forms_and_where_they_stand(spark):
    mail, ip = "bob@example.com", "203.0.113.42"
    cases = {
        f"x {_b64(ip)} y": "x [TG:IP:1] y",
        "MjAzLjAuMTEzLjQy": "[TG:IP:1]",
        f"k={_b64('mail to ' + mail, True).rstrip('=')};": "k=[TG:EMAIL:1];",
        f"h {mail.encode().hex()} {mail.encode().hex().upper()}": "h [TG:EMAIL:1] [TG:EMAIL:2]",
        "id=bob%40example.com&x=1": "id=[TG:EMAIL:1]&x=1",
        "203%2e0%2E113%2e42, bob&#64;example&period;com": "[TG:IP:1], [TG:EMAIL:1]",
        f"{mail} or {_b64(mail)} or {mail} or {_b64(mail)}": "[TG:EMAIL:1] or [TG:EMAIL:2] or [TG:EMAIL:1] or [TG:EMAIL:2]",
        f"a {_b64(mail.encode().hex())} b": "a [TG:EMAIL:1] b",
        f"a {_b64('see ' + urllib.parse.quote(mail, safe=''))} b": "a [TG:EMAIL:1] b",
        f"a {_b64(_b64(_b64(ip)))} b": "a [TG:IP:1] b",
        "a%20b &amp; nothing dGhpcyBpcyBub3RoaW5n 5468697320697320": "a%20b &amp; nothing dGhpcyBpcyBub3RoaW5n 5468697320697320",
        "two in one: " + _b64(f"{mail}, {ip}"): "two in one: [TG:EMAIL:1]",
        "é日本 203%2e0%2e113%2e42 ü": "é日本 [TG:IP:1] ü",
        "&#x110000; &#55296; &#0; %ff%fe %zz AAAAAAAAAAAAAAAA": "&#x110000; &#55296; &#0; %ff%fe %zz AAAAAAAAAAAAAAAA",
        "[TG:IP:3] 203%2e0%2e113%2e42": "[TG:IP:3] [TG:IP:4]",
    }
    got = _run(spark, list(cases))
    assert [r["text"] for r in got] == list(cases.values())
    assert [r["encoded"] for r in got] == [1, 1, 1, 2, 1, 2, 2, 1, 1, 1, 0, 1, 1, 0, 1]


def test_without_encoded_values_it_is_redact(spark):
    texts = [None, "", "plain bob@example.com", f"{_b64('nothing here at all')} bob@example.com 10.0.0.1", "postgres://u:p@db.example.com:5432/x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    both = redact_encoded(df, "text", PATTERNS, "a").select("a", redact("text", PATTERNS).alias("b")).collect()
    assert all(r["a"].asDict() | {"encoded": None} == r["b"].asDict() | {"encoded": None} for r in both)


def test_random_mixtures(spark):
    rng = random.Random(7)
    forms = {
        "plain": lambda v: v, "b64": _b64, "safe": lambda v: _b64(v, True), "hex": lambda v: v.encode().hex(),
        "url": lambda v: "".join(f"%{ord(c):02x}" if c in "@." or rng.random() < 0.2 else c for c in v),
        "ent": lambda v: "".join(f"&#{ord(c)};" if c in "@." else c for c in v),
        "twice": lambda v: _b64(_b64(v)),
    }
    texts, wanted = [], []
    for _ in range(80):
        parts, want, seen, count = [], [], {}, {}
        for _ in range(rng.randrange(1, 9)):
            kind, value = rng.choice([("EMAIL", f"user{rng.randrange(3)}@example.com"), ("IP", f"203.0.113.{rng.randrange(10, 13)}"), ("", "wörd")])
            form = value if not kind else forms[rng.choice(list(forms))](value)
            parts.append(form)
            want.append((kind, value, form))
        text = " , ".join(parts)
        # A value's first form has the number of the value by order; others come after the category's last.
        for kind, value, _ in want:
            if kind and (kind, value) not in seen:
                count[kind] = count.get(kind, 0) + 1
                seen[kind, value] = count[kind]
        tokens = {}
        for kind, value, form in want:
            if kind and form not in tokens:
                n = seen.pop((kind, value), None)
                if n is None:
                    count[kind] += 1
                    n = count[kind]
                tokens[form] = f"[TG:{kind}:{n}]"
        texts.append(text)
        wanted.append(" , ".join(tokens.get(form, form) for _, _, form in want))
    assert [r["text"] for r in _run(spark, texts)] == wanted


def test_long_texts_and_blobs(spark):
    blob = base64.b64encode(random.Random(1).randbytes(300_000)).decode()
    many = " ".join(f"u{i}&#64;example.com" for i in range(300))
    got = _run(spark, [f"{blob} bob%40example.com", many, "word " * 50_000 + "203%2e0%2e113%2e42"])
    assert got[0]["text"] == f"{blob} [TG:EMAIL:1]" and got[1]["text"] == " ".join(f"[TG:EMAIL:{i + 1}]" for i in range(300))
    assert got[2]["tokens"] == ["[TG:IP:1]"] and html.unescape(got[1]["values"][7]) == "u7@example.com"
