"""Operators over single documents: contracts, round trips, held-out accuracy, odd rows."""

import collections
import datetime as dt
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pathlens.llm import bpe, catalog, fingerprint, mixing, pseudonyms, quality, revisits, token_store, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "other", None), (None, None, None), (2, "", "y"), (3, "word " * 4000, "x"), (4, None, "y"), (5, "Ünï 中文\n\n<|endoftext|> 's", "y")]
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.selectExpr("*", "1 AS size", "'c' AS copies", "0.5 AS score", "'k' AS text_key", "true AS held_out")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# pseudonyms


def renamed(spark, *texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonyms.pseudonymise(df, key).orderBy("doc_id").collect()]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0


def test_cards_stay_valid_and_linked(spark):
    a, b, c = renamed(spark, "4465758382889437", "x 4465 7583 8288 9437 y", "4465758382889438 9807915762804490")
    assert a != "4465758382889437" and luhn(a) and a[:2] == "44" and len(a) == 16
    assert re.sub(r"\D", "", b) == a and re.fullmatch(r"x \d{4} \d{4} \d{4} \d{4} y", b)
    assert c == "4465758382889438 9807915762804490"


def test_cards_are_permuted_without_collision(spark):
    from pyspark.sql import functions as F

    n = spark.range(10_000).select(pseudonyms.permute_string(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("p"))
    assert n.distinct().count() == 10_000 and n.where("p RLIKE '^[0-9]{4}$'").count() == 10_000


def test_other_kinds(spark):
    phone, ip, date, mail, iban, ssn = renamed(spark, "+1 (743) 555-3824", "8.196.197.208 300.1.1.1", "1987-03-12 12.03.1987 2024-02-31", "A Hein.19@mail5.example.com!!", "DE89 3704 0044 0532 0130 00", "123-45-6789 000-12-3456")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and "555-3824" not in phone
    first, second = ip.split()
    assert first != "8.196.197.208" and all(int(x) < 256 for x in first.split(".")) and second == "300.1.1.1"
    iso, dotted, bad = date.split()
    assert iso != "1987-03-12" and dt.date.fromisoformat(iso).strftime("%d.%m.%Y") == dotted and bad == "2024-02-31"
    assert re.fullmatch(r"A [A-Z][a-z]{3}\.\d\d@mail5\.example\.com!!", mail) and "Hein" not in mail
    plain = iban.replace(" ", "")
    assert iban[:2] == "DE" and iban != "DE89 3704 0044 0532 0130 00" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4} 000-12-3456", ssn) and not ssn.startswith("123-45")


def test_phones_in_any_grouping(spark):
    same = ["+1 (743) 555-3824", "+1 743 555 3824", "+17435553824", "+1-743-555-3824", "(743) 555-3824", "743 555 3824", "743-555-3824"]
    french = ["+33 6 12 34 56 78", "+33612345678", "+33 (6) 12.34.56.78", "06 12 34 56 78", "06.12.34.56.78"]
    others = ["+49 30 1234567", "+49 (30) 123-4567", "+34 612 345 678", "+44 20 7946 0958", "+351 21 123 4567", "+33\u00a06\u00a012\u00a034\u00a056\u00a078"]
    given = same + french + others
    got = renamed(spark, *given)
    for old, new in zip(given, got):
        assert old != new and re.sub(r"\d", "d", old) == re.sub(r"\d", "d", new), (old, new)
        kept = re.match(r"\+(1|33|34|44|49|351)|0(?=\d[ .])|", old).group()
        assert new.startswith(kept)
    digits = [re.sub(r"\D", "", x) for x in got]
    assert len({x[-10:] for x in digits[: len(same)]}) == 1 and len({x[-9:] for x in digits[len(same) :][: len(french)]}) == 1
    assert digits[12] == digits[13]
    around = renamed(spark, "(+1 743 555 3824), 2 apples", "+33 6 12 34 56 78 2 fois", "tel: 06 12 34 56 78.", "a +49 30 1234567, b")
    assert around[0] == f"({got[1]}), 2 apples" and around[1] == f"{got[7]} 2 fois" and around[2] == f"tel: {got[10]}." and around[3] == f"a {got[12]}, b"
    clean = "+123 456, 1 + 2345678, +12345678901234567890 12 34 56 78 90 10 20 30 555 1234 +1 2"
    assert renamed(spark, clean) == [clean]


def test_key_and_clean_texts(spark):
    assert renamed(spark, "4465758382889437", key="a") != renamed(spark, "4465758382889437", key="b")
    clean = "v1.2.3 Version 2.0, 1234 and b44e15e09fd311c3cf3163b66d5a9875b883d8ce!"
    assert renamed(spark, clean, "", None, "4" * 40_000) == [clean, "", None, "4" * 40_000]


def test_dates_are_permuted_within_their_days(spark):
    from pyspark.sql import functions as F

    d = spark.range(3000).select(pseudonyms.date(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).cast("string"), "k").alias("d"))
    rows = {r.d for r in d.collect()}
    assert len(rows) == 3000 and all("1900-01-01" <= r <= "2100-05-01" for r in rows)


def plain_permute(values, radices, key, kind):
    values = list(values)
    for step in range(8):
        rest = ",".join("." if i % 2 == step % 2 else str(x) for i, x in enumerate(values))
        for i in range(step % 2, len(values), 2):
            shift = int(hashlib.sha256(f"{key}|{kind}|{step}|{i}|{rest}".encode()).hexdigest()[:12], 16)
            values[i] = (values[i] + shift % radices[i]) % radices[i]
    return values


def plain_string(text, key, kind):
    base = lambda c: next((b for b, group in ((48, "0123456789"), (97, "abcdefghijklmnopqrstuvwxyz"), (65, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if c in group), 0)
    moved = plain_permute([ord(c) - base(c) if base(c) else 0 for c in text], [{48: 10, 0: 1}.get(base(c), 26) for c in text], key, kind)
    return "".join(chr(base(c) + x) if base(c) else c for c, x in zip(text, moved))


def plain_pseudonym(m, key):
    """What one candidate becomes, written from the table of kinds and not from the operator."""
    import regex

    form = lambda shape, symbols, keep: "".join(next(symbols) if c in keep else c for c in shape)
    digits, whole = re.sub("[^0-9]", "", m), lambda p: regex.fullmatch(p, m, regex.ASCII)
    by_97 = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    if "@" in m:
        local, domain = m.split("@")
        return plain_string(local, key, "email") + "@" + domain
    if m[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        plain = m.replace(" ", "")
        if by_97(plain[4:] + plain[:4]) != 1:
            return m
        account = plain_string(plain[4:], key, "iban")
        return form(m, iter(f"{plain[:2]}{98 - by_97(account + plain[:2] + '00'):02d}{account}"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    if whole(pseudonyms.CARD):
        if not (13 <= len(digits) <= 19 and re.match(pseudonyms.ISSUER, digits) and luhn(digits)):
            return m
        body = digits[:2] + plain_string(digits[2:-1], key, "card")
        return form(m, iter(next(body + c for c in "0123456789" if luhn(body + c))), "0123456789")
    if whole(pseudonyms.PHONE):
        kept = re.match(pseudonyms.COUNTRY, re.sub("[^0-9+]", "", m) if m[0] == "+" else m)
        n = len(re.sub("[^0-9]", "", kept.group())) if kept else 0
        return form(m, iter(digits[:n] + plain_string(digits[n:], key, "phone")), "0123456789") if 7 <= len(digits) - n <= 14 else m
    if whole(pseudonyms.SSN):
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        areas = [x for x in range(1, 900) if x != 666]
        if area not in areas or not group or not serial:
            return m
        a, g, n = plain_permute([areas.index(area), group - 1, serial - 1], [898, 99, 9999], key, "ssn")
        return f"{areas[a]:03d}-{g + 1:02d}-{n + 1:04d}"
    if whole(pseudonyms.DATE):
        for begins, shape in ((r"\d{4}-", "%Y-%m-%d"), (r"\d\d/", "%m/%d/%Y"), (r"\d\d/", "%d/%m/%Y"), (r"\d\d\.", "%d.%m.%Y")):
            try:
                day = (dt.datetime.strptime(m, shape).date() - dt.date(1900, 1, 1)).days
            except ValueError:
                continue
            if re.match(begins, m) and 0 <= day < 270 * 271:
                a, b = plain_permute(divmod(day, 271), [270, 271], key, "date")
                return (dt.date(1900, 1, 1) + dt.timedelta(days=a * 271 + b)).strftime(shape)
        return m
    parts = [int(x) for x in m.split(".")]
    return ".".join(map(str, plain_permute(parts, [256] * 4, key, "ipv4"))) if max(parts) < 256 else m


def test_pseudonyms_equal_a_plain_version(spark):
    import regex

    docs = catalog.table(spark, SF, "documents").select("doc_id", "text")
    extra = ["4465-7583-8288-9437 4465758382889437, 07/04/1999 31/12/2001 31.12.2001 1899-12-31 10.0.0.256", "DE89370400440532013000 123-45-6789 999-12-3456 x.y+z@a.b-c.org +33 6 12 34 56 78 06 12 34 56 78"]
    docs = docs.unionByName(spark.createDataFrame([(-n - 1, t) for n, t in enumerate(extra)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "k").collect()}
    found = 0
    for r in docs.collect():
        olds = []
        want = regex.sub(pseudonyms.ANY, lambda m: olds.append((m.group(), plain_pseudonym(m.group(), "k"))) or olds[-1][1], r.text, flags=regex.ASCII)
        assert got[r.doc_id].text == want, (r.doc_id, olds)
        assert got[r.doc_id].n_found == sum(a != b for a, b in olds)
        found += got[r.doc_id].n_found
    assert found > 20


# fingerprints


def test_fingerprints(spark, odd, none):
    texts = ["a b c d e f g h", "A, b c d e f g h!", "q r s t u v w x y z", "", None, "w " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fingerprint.report(df).orderBy("doc_id").collect()
    for i, r in enumerate(rows):
        t, n = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()
    assert rows[0].fingerprint == rows[1].fingerprint and rows[0].near_next == 1 and rows[1].near_next == 0 and rows[3].fingerprint == rows[4].fingerprint
    assert fingerprint.report(odd).count() == len(ODD) and fingerprint.report(none).count() == 0
    assert fingerprint.report(df.limit(1)).first().near_next == 1


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(4000)) for _ in range(2))
    for scale, error in ((1, 0.002), (2, 0.02), (16, 0.08)):
        df = spark.createDataFrame([(a, a + " " + b)], "a string, b string").select(fingerprint.sketch(F.col("a"), scale).alias("a"), fingerprint.sketch(F.col("b"), scale).alias("b"))
        r = df.select("a", fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.likeness(F.col("a"), F.col("b")).alias("l"), (fingerprint.merge(F.col("a"), F.col("b")) == F.col("b")).alias("m")).first()
        assert r.c == 1 and abs(r.l - 0.5) < error and r.m and abs(len(r.a.hashes) - 4000 / scale) < 4 * (4000 / scale) ** 0.5 + 5


def test_fingerprints_equal_a_plain_version(spark):
    """Every text keeps exactly the shingle hashes below the one fraction, and estimates follow from these sets."""
    from pyspark.sql import functions as F

    docs = catalog.table(spark, SF, "documents")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    kept, exact = [], []
    hashes = docs.select("doc_id", fingerprint.shingles(F.col("text")).alias("h")).collect()
    by_id = {r.doc_id: r.h for r in hashes}
    for r in rows:
        w, h = words(r.text), by_id[r.doc_id]
        plain = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
        assert len(set(h)) == len(plain)
        exact.append(set(h))
        kept.append({x for x in h if x <= -(2**63) + 2**64 // fingerprint.SCALE - 1})
    got = {r.doc_id: r for r in fingerprint.report(docs).collect()}
    errors = []
    for n, r in enumerate(rows):
        a, b = kept[n], kept[(n + 1) % len(rows)]
        said = got[r.doc_id].fingerprint
        assert {int(said[i : i + 16], 16) for i in range(16, len(said), 16)} == {x % 2**64 for x in a}
        want = len(a & b) / len(a | b) if a | b else float(min(exact[n]) == min(exact[(n + 1) % len(rows)]))
        assert got[r.doc_id].near_next == pytest.approx(want)
        true = exact[n] & exact[(n + 1) % len(rows)], exact[n] | exact[(n + 1) % len(rows)]
        errors.append(abs(got[r.doc_id].near_next - len(true[0]) / len(true[1])))
    assert sum(errors) / len(errors) < 0.02


def test_next_document_with_outlying_null_and_tied_ids(spark, monkeypatch):
    from pathlens.operators import ordering

    monkeypatch.setattr(ordering, "PER_BUCKET", 4)
    ids = [*range(300), 10**15, -(10**17), *([77] * 40), None, None]
    df = spark.createDataFrame([(i, f"text {n} of many with some words {n}") for n, i in enumerate(ids)], DOCS.split(", source")[0])
    rows = fingerprint.with_next(df, rows=16).select("doc_id", "text", "next.text").toDF("doc_id", "text", "after").collect()
    after = {r.text: r.after for r in rows}
    assert len(after) == len(ids)
    whose = {r.text: r.doc_id for r in rows}
    at, line = next(iter(after)), []
    for _ in ids:
        line.append(whose[at])
        at = after[at]
    first = min(range(len(line)), key=lambda i: (line[i] is not None, line[i] or 0, line[i - 1] is None))
    turned = line[first:] + line[:first]
    assert turned == sorted(ids, key=lambda i: (i is not None, i or 0))


# revisits


def rec(i, url, sec, kind, headers=None, digest=None):
    return (i, url, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=sec) if sec is not None else None, kind, headers, digest)


def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(revisits, "STRETCH", 2)
    rows = [
        rec(1, "http://A.org:80/x/?b=2&a=1&utm_s=1#f", 10, "response", {"etag": '"1"', "date": "d1", "content-length": "9"}), rec(2, "https://www.a.org/x?a=1&b=2", 50, "revisit", {"etag": 'W/"1"', "date": "d2", "content-length": "0"}),
        rec(3, "http://a.org/x?a=1&b=2", 10, "revisit", {"etag": '"1"'}), rec(4, "http://a.org/x?a=1&b=2", 60, "response", {"etag": '"2"'}), rec(5, "http://a.org/x?a=1&b=2", 70, "revisit", {"etag": '"1"'}),
        rec(6, "http://a.org/x?a=1&b=2", 80, "revisit", None), rec(7, None, 80, "revisit", {}), rec(8, "http://a.org/x?a=1&b=2", None, "revisit", {}), rec(9, "http://n.org/", 5, "revisit", {}),
        rec(10, "http://a.org/x?a=1&b=2", 60, "response", {"etag": '"2"'}), rec(11, "http://d.org", 1, "response", None, "q"), rec(12, "http://d.org/", 2, "revisit", {}, "q"),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts timestamp, kind string, headers map<string,string>, digest string").selectExpr("*", "1 AS page", "2 AS found")
    got = {r.record_id: (r.response_id, r.verdict, r.headers) for r in revisits.resolve(df).collect()}
    assert got[2] == (1, "resolved", {"etag": 'W/"1"', "date": "d2", "content-length": "9"})
    assert got[3][1] == got[7][1] == got[8][1] == got[9][1] == "missing"
    assert got[5][:2] == (10, "changed") and got[6][:2] == (10, "unchecked") and got[12][:2] == (11, "resolved") and len(got) == 8
    assert revisits.resolve(df.limit(0)).count() == 0


def test_crawl_has_addresses_with_many_responses(spark):
    sf = "/root/testdata/sf0.01"
    rows = revisits.report(catalog.table(spark, sf, "pages")).collect()
    apart = [r for r in rows if r.response_id is not None and r.response_id // 4 != r.page_id]
    verdicts = collections.Counter(r.verdict for r in rows)
    assert len(rows) == 2 * 250 and len(apart) > 50 and min(verdicts[v] for v in ("resolved", "changed", "missing")) > 20


@pytest.mark.parametrize("packed", [False, True])
def test_warc_records(spark, tmp_path, packed):
    import gzip

    def record(kind, number, body, more=""):
        body = body.encode()
        head = f"WARC/1.{packed + 0}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{number}>\r\nWARC-Date: 2024-01-01T00:00:{number:02d}Z\r\nWARC-Target-URI: http://a.org/x\r\n{more}Content-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    parts = [
        record("warcinfo", 1, "software: x\r\n"), record("response", 2, "HTTP/1.1 200 OK\r\nETag: \"1\"\r\nDate: d1\r\n\r\n<p>\r\n\r\n</p>", "WARC-Payload-Digest: sha1:Q\r\n"),
        record("revisit", 3, "HTTP/1.1 304 Not Modified\r\nETag: W/\"1\"\r\nDate: d3\r\n\r\n", "WARC-Refers-To: <urn:2>\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified\r\n"),
        record("revisit", 4, "HTTP/1.1 304 Not Modified\r\nETag: \"9\"\r\n\r\n"),
    ]
    path = tmp_path / ("a.warc.gz" if packed else "a.warc")
    path.write_bytes(b"".join(gzip.compress(p) for p in parts) if packed else b"".join(parts))
    records = revisits.read_warc(spark, str(path))
    assert sorted((r.kind, r.whole) for r in records.collect()) == [("response", True), ("revisit", True), ("revisit", True), ("warcinfo", True)]
    response = records.where("kind = 'response'").first()
    assert response.headers == {"etag": '"1"', "date": "d1"} and response.digest == "sha1:Q" and response.url == "http://a.org/x"
    got = {r.ts.second: (r.response_id, r.verdict, r.headers) for r in revisits.resolve(records).collect()}
    assert got[3] == (response.record_id, "resolved", {"etag": 'W/"1"', "date": "d3"}) and got[4][1] == "changed"
    assert records.where("refers_to IS NOT NULL").first().refers_to == response.record_id


# mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "é", "Z", None])) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.report(df).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    source = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.taken <= 2 * r.size and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) < 0.15 * want[s] for s in want)
    assert sorted(got) == sorted(mixing.report(df).collect())
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixing.report(odd).count() == len(ODD) and mixing.mix(none).count() == 0


# classifiers


def auc(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    return float((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


@pytest.mark.parametrize(("query", "label", "size", "least", "recall", "precision"), [("op3_quality", "quality", "0.01", 0.97, 0.9, 0.9), ("op6_toxicity", "toxic", "0.01", 0.9, 0.7, 0.8), ("op6_toxicity", "toxic", "0.1", 0.9, 0.9, 0.9)])
def test_held_out_accuracy(spark, query, label, size, least, recall, precision):
    sf = f"/root/testdata/sf{size}"
    got = catalog.queries()[query](spark, sf).toPandas()
    labels = catalog.table(spark, sf, "labels").toPandas()
    fold, held = (5, 0) if label == "quality" else (4, 2)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == held) for r in got.itertuples())
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert auc(both.score.to_numpy(), both[label].to_numpy()) >= least
    hit = ((both.predicted == 1) & (both[label] == 1)).sum()
    assert hit >= recall * (both[label] == 1).sum() and hit >= precision * (both.predicted == 1).sum()


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, odd, none, operator):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert operator.report(odd, labels).count() == len(ODD)
    assert operator.report(none, labels).count() == 0
    assert operator.report(odd, labels.limit(0)).select("score").distinct().count() == 1


def test_internal_names_may_be_taken(spark):
    rows = [(n, "some words of a text " * 3, "s", n, n, n, n, n, n, n, n) for n in range(4)]
    names = ["size", "copies", "Target", "source_size", "mix_source", "quality_score", "pseudonymised", "mix_copy"]
    df = spark.createDataFrame(rows, DOCS + "".join(f", `{n}` int" for n in names))
    assert set(map(tuple, mixing.mix(df).collect())) <= set(rows) and mixing.mix(df).columns == df.columns
    kept = quality.keep_good(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert sorted(map(tuple, kept.collect())) == rows and kept.columns == df.columns
    assert [tuple(r)[:-1] for r in pseudonyms.pseudonymise(df, "k").orderBy("doc_id").collect()] == rows


def test_documents_without_id_are_drawn_apart(spark):
    rows = [(None, " ".join(f"w{n}" for _ in range(10)), "a") for n in range(500)] + [(n, "x " * 10, "b") for n in range(100)]
    got = mixing.report(spark.createDataFrame(rows, DOCS)).where("doc_id IS NULL").collect()
    assert abs(sum(r.taken for r in got) - got[0].target) < 0.1 * got[0].target


def test_quality_keeps_columns(odd, spark):
    kept = quality.keep_good(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert kept.columns == odd.columns and kept.where("score <> 0.5").count() == 0


def plain_features(text):
    """The features of one text, counted one by one."""
    words, lines = re.findall(r"\w+", text.lower()), [x for x in text.split("\n") if x]
    n, w, k = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    count = lambda chars: sum(c in chars for c in text)
    pairs = list(zip(words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / w, sum(c.isupper() for c in text) / n, count("0123456789") / n, count(" \n\t") / n,
        count("$%&*#|@^~<>{}[]=+\\/_") / n, count(".") / w, count(",;:") / w, count("!?") / w,
        np.log1p(len(lines)), np.log1p(len(text) / k), 1 - len(set(lines)) / k,
        len(set(words)) / w, sum(a == b for a, b in pairs) / w, max(collections.Counter(words).values(), default=0) / w, sum(len(x) <= 2 for x in words) / w, sum(len(x) >= 14 for x in words) / w,
        1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
    ]


def test_quality_equals_a_plain_version(spark):
    docs, labels = catalog.table(spark, SF, "documents"), catalog.table(spark, SF, "labels")
    texts = [r.text for r in docs.limit(120).collect()] + ["", "one", "a a a\n\nB", "x" * 9000]
    # a line break at the end of a text makes no line; blank lines count as none
    np.testing.assert_allclose(quality.features(texts), [plain_features(t) for t in texts], rtol=1e-9)
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.report(docs, labels).collect()}
    for r in docs.limit(60).collect():
        x = plain_features(r.text)
        bins = [sum(e <= v for e in edges) for v, edges in zip(x, model.edges)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_decoding_equals_trying_every_reading():
    """Viterbi finds the cheapest path of the lattice: all paths of short spans are tried."""
    import itertools

    lm = toxicity.language_model(toxicity.trigram_counts(["the stupid clown is an idiot and a loser", "you sad moron"] * 300))
    flat = lm.ravel().tolist()
    rng = random.Random(3)
    spans = ["1d10t", "l0$3r", "i_d_i_o_t", "m0r.n", "s-a-d", "4 5", "iddiot", "c|own", "(!d", "+h3"] + ["".join(rng.choices("ido1t0 .-$", k=rng.randint(1, 6))) for _ in range(150)]

    def cost(path):
        total, letters = sum(extra for _, extra in path), "".join(x for x, _ in path)
        for word in letters.split():
            before = (0, 0)
            for k in [*map(toxicity.code, word), 0]:
                total -= float(lm[before[0], before[1], k])
                before = before[1], k
        return total, letters.split()

    for span in spans:
        tried = [cost(p) for p in itertools.product(*toxicity.lattice(span))]
        least = min(c for c, _ in tried)
        found = toxicity.decode(span, flat)
        assert min(c for c, said in tried if said == found) == pytest.approx(least, abs=1e-3), (span, found)


def test_disguises_are_undone():
    words = ["the stupid clown is an idiot and a loser", "pathetic trash and other words of this text"] * 200
    lm = toxicity.language_model(toxicity.trigram_counts(words))
    at = toxicity._register(lm)
    for said, meant in (("1d10t", "idiot"), ("l.o.s.e.r", "loser"), ("s t u p i d", "stupid"), ("tr@sh", "trash"), ("clooooown", "clown"), ("p4theti(", None)):
        found = toxicity.restorations(f"well {said} you", at)
        assert meant is None or found == [meant], (said, found)
    assert toxicity.restorations("plain words, of a text. It ends!", at) == []


def test_disguises_of_any_make_and_rate():
    words = ["stupid", "clown", "idiot", "loser", "pathetic", "trash", "moron", "worthless", "disgusting", "coward"]
    said = ["the stupid clown is an idiot and a loser and no saint", "pathetic worthless trash and a moron", "shit on your ass and other words of this text", "disgusting coward"] * 200
    at = toxicity._register(toxicity.language_model(toxicity.trigram_counts(said)))
    for said, meant in (
        ("1d107", "idiot"), ("l053r", "loser"), ("l0$3r", "loser"), ("p4th371c", "pathetic"), ("w0r7hl3$$", "worthless"), ("57up1d", "stupid"), ("$7up1d", "stupid"), ("sh17", "shit"), ("!diot", "idiot"), ("@ss", "ass"),
        ("(1d10t)", "idiot"), ("1d10t!!", "idiot"), ("_idi0t_", "idiot"), ("i_d_i_o_t", "idiot"), ("i/d/i/o/t", "idiot"), ("i\td\ti\to\tt", "idiot"), ("s - t - u - p - i - d", "stupid"), ("1 d 1 0 t", "idiot"), ("iddiioott", "idiot"),
    ):
        assert toxicity.restorations(f"well {said} you", at) == [meant], said
    signs = {c: "".join(k for k, v in toxicity.LOOKALIKES.items() if c in v and k in "0134579@$!") for c in "abcdefghijklmnopqrstuvwxyz"}
    rng = random.Random(5)
    for rate in (0.2, 0.5, 0.8, 1.0):
        right = tried = 0
        while tried < 200:
            word = rng.choice(words)
            shown = "".join(rng.choice(signs[c]) if signs[c] and rng.random() < rate else c for c in word)
            if shown != word and re.search("[a-z]", shown):
                tried += 1
                right += word in toxicity.restorations(f"well {shown} you", at)
        assert right >= 0.95 * tried, (rate, right)


def test_every_text_with_a_disguise_is_decoded():
    at = toxicity._register(toxicity.language_model(toxicity.trigram_counts(["an idiot and a loser"] * 300)))
    texts = ["", "an idiot", "1d107 and l053r", "i_d", " ", "i_d_i_o_t", "t 3 x t" + "!" * 9, "a" * 5000, "_" * 5000 + "1d10t"]
    got = toxicity.block_restorations(toxicity.textkit.Words(texts), at)
    assert [toxicity.restorations(t, at) for t in texts] == got
    assert got[2] == ["idiot", "loser"] and got[5] == got[8] == ["idiot"] and got[0] == got[1] == got[4] == []


def test_separators_may_be_edges_of_words():
    words = ["the stupid clown is an idiot and you are a loser"] * 300
    at = toxicity._register(toxicity.language_model(toxicity.trigram_counts(words)))
    for said, meant in (("you are a i d i o t", ["idiot"]), ("s t u p i d c l o w n", ["stupid", "clown"]), ("s t u p i d   c l o w n", ["stupid", "clown"]), ("the s.t.u.p.i.d.c.l.o.w.n.a.n.d.l.o.s.e.r.i.s.a.n.i.d.i.o.t", ["stupid", "clown", "and", "loser", "is", "an", "idiot"]), ("1d10t-l0ser", ["idiot", "loser"])):
        assert toxicity.restorations(said, at) == meant, said


# token store


def test_ids_equal_the_library():
    e = bpe.encoder(catalog.tokenizer_file())
    rng = random.Random(0)
    texts = ["".join(rng.choices(" ab'sdtlrev\n\t.,1²é中  ", k=rng.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|>", "it's we'll I'd'VE", "　x"]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_of_other_vocabularies_are_the_library_s():
    assert bpe.encoder(catalog.tokenizer_file()).known
    e = bpe.Encoder(catalog.tokenizer_file("word_bpe_49k.json"))
    texts = ["Some Words, 123!", "", "  ÉTÉ\n中文 "]
    assert not e.known and [ids.tolist() for ids in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_round_trip(spark, odd, none, tmp_path):
    tok = catalog.tokenizer_file()
    path = str(tmp_path / "store")
    token_store.write(odd, path, tok)
    encode = lambda t: [*bpe.encoder(tok).tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    got = token_store.read(spark, path).orderBy("start").collect()
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(encode(t)) for _, t, _ in ODD)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((i for i, *_ in ODD), key=lambda i: (i is not None, i))
    sums = {(r.start, r.ids_crc32) for r in token_store.digests(spark, path).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    stored = spark.read.parquet(path + "/objects").where("ids IS NOT NULL")
    assert stored.count() == stored.select("chunk").distinct().count()
    token_store.write(none, path + "0", tok)
    assert token_store.digests(spark, path + "0").count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 20_000).astype("<u4")
    ends = token_store.cuts(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= token_store.MOST
    moved = token_store.cuts(np.concatenate([rng.integers(0, 50_000, 333).astype("<u4"), ids]))
    assert len({e - 333 for e in moved} & set(ends)) > 0.8 * len(ends)


def test_damage_is_noticed(spark, tmp_path):
    with pytest.raises(ValueError, match="damaged"):
        import pyarrow as pa

        list(token_store._stored([pa.RecordBatch.from_arrays([pa.array([b"0" * 32]), pa.array([2]), pa.array([b"\1\0"])], ["a", "b", "c"])]))


# pipeline


def test_pipeline(spark):
    docs = catalog.table(spark, SF, "documents")
    columns, now, seen = docs.columns, docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == columns
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    good, first, unleaked, mixed = seen
    assert good >= first >= unleaked >= mixed and mixed
    items = [r.text for r in catalog.table(spark, SF, "benchmark").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert not any(i in text[d] for d in unleaked for i in items) and len({text[d] for d in first}) == len(first)
    labels = {r.doc_id: r.quality for r in catalog.table(spark, SF, "labels").collect()}
    assert sum(labels[d] == 1 and d not in good for d in labels) <= 0.03 * len(labels)
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in now.select("doc_id").collect())
    tok = bpe.encoder(catalog.tokenizer_file()).tokenizer
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        ids = [*tok.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pipeline_on_an_empty_table(spark, none):
    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
