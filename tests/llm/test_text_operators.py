from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociweave.llm import decontam, imatch, linededup, pii
from tests.llm.conftest import SCHEMA, edge_texts, prose, rows_of


# Line dedup


def slow_lines(rows, least):
    """Deleted places by key: every later document against every earlier one, all stretches of lines that both have."""

    def lines(text):
        return [(i, x.strip(" \t\r\v\f")) for i, x in enumerate(text.split("\n")) if x.strip(" \t\r\v\f")]

    texts, gone = {}, {}
    for key, text in rows:
        if key is not None and text is not None:
            texts.setdefault(key, []).append(lines(text))
    for key, earlier in product(texts, texts):
        if earlier < key:
            for b, a in product(texts[key], texts[earlier]):
                for i, j in product(range(len(b)), range(len(a))):
                    n = 0
                    while i + n < len(b) and j + n < len(a) and b[i + n][1] == a[j + n][1]:
                        n += 1
                    if sum(len(x.split()) for _, x in b[i : i + n]) >= least:
                        gone.setdefault(key, set()).update(range(b[i][0], b[i + n - 1][0] + 1))
    return gone


def rewritten(rows, gone):
    out = []
    for k, t in rows:
        own = gone.get(k, set()) & set(range(t.count("\n") + 1)) if t is not None else set()
        out.append((k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in own) if own else t, len(own)))
    return Counter(out)


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    pool = [prose(rng, rng.randint(1, 9)) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(["", *pool]) if rng.random() < 0.7 else prose(rng, 5) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    for i in range(80, 140):  # stretches of others, moved and repeated
        pieces = []
        for _ in range(rng.randint(1, 4)):
            lines = rng.choice(rows)[1].split("\n")
            at = rng.randrange(len(lines))
            pieces += lines[at : at + rng.randint(1, 6)]
        rows.append((i, "\n".join(pieces)))
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(None, rows[3][1]), (600, None), (601, ""), (602, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = slow_lines(rows, 6)
    got = linededup.deduplicated(docs, least=6).collect()
    assert Counter((r["doc_id"], r["text"], r["n_removed"]) for r in got) == rewritten(rows, gone) and len(gone) > 50


def test_lines_that_stood_singly_before_are_part_of_blocks(spark):
    a, b = "a line of five words", "another one of five words"
    rows = [(0, a), (1, b), (2, f"unique one\n{a}\n\n{b}\nunique two"), (3, f"unique three\n{a}\n{b}\nunique four")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == ("unique three\nunique four", 2) and got[2] == (rows[2][1], 0)
    found = linededup.blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["first"], r["key"], r["at_first"], r["at"], r["to"]) for r in found] == [(2, 3, 1, 1, 2)]


def test_documents_of_very_many_lines(spark):
    text = "\n".join(f"line number {i} of a very long document with ten words" for i in range(20_000))
    changed = text.replace("number 777 ", "number x ").replace("number 9000 ", "number y ")
    got = {r["doc_id"]: r for r in linededup.deduplicated(spark.createDataFrame([(1, text), (2, changed)], "doc_id long, text string")).collect()}
    assert got[1]["text"] == text and got[2]["n_removed"] == 19_998 and got[2]["text"].count("\n") == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=12), st.lists(st.sampled_from("abcdefg"), max_size=12))
def test_patience_is_a_common_subsequence(a, b):
    found = linededup.patience(dict(enumerate(a)), dict(enumerate(b)))
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_lines_edge_cases(edge, empty):
    got = linededup.deduplicated(edge)
    assert got.count() == edge.count()
    assert linededup.deduplicated(empty).count() == 0


# Decontamination


def slow_leaks(docs, items, n=5, contained=0.8):
    def shingles(words, n):
        return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()

    out = set()
    for (d, text), (i, item) in product(docs, items):
        own = decontam.words(item)
        k = min(n, len(own))
        want = shingles(own, k)
        shared = len(want & shingles(decontam.words(text), k))
        if want and shared >= len(want) * contained:
            out.add((d, i, len(want), shared))
    return out


def test_leaks_match_brute_force(spark, edge):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 4, 5, 6, 12, 30, 60, 200]))) for i in range(40)] + [(90, None), (91, "..."), (92, "")]
    items.append((93, items[8][1]))
    docs = [(i, say(rng.randint(0, 800))) for i in range(60)]
    for i in range(60, 120):
        item = rng.choice(items[:40])[1].split()
        if len(item) > 20 and rng.random() < 0.5:
            item[rng.randrange(len(item))] = "changed"
        docs.append((i, f"{say(rng.randint(0, 600))} {' '.join(item).upper()}! {say(rng.randint(0, 600))}"))
    docs += [(None, docs[-1][1]), (200, docs[-1][1]), (200, "other text"), (201, None), (202, "")]
    piece = decontam.PIECE
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got.collect())
    assert found == Counter(slow_leaks(docs, items)) and len(found) > 60
    assert piece == decontam.PIECE
    kept = decontam.cleaned(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {k[0] for k in found}


def test_pieces_of_long_documents(monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 64)
    rng = random.Random(2)
    words = [f"x{rng.randrange(10**6)}".encode() for _ in range(2000)]
    for at in (0, 55, 60, 63, 64, 700, 1980):
        item = b" ".join(words[at : at + 20]).decode()
        slots = decontam.item_slots(item)
        bitmap = np.full(1 << decontam.BITMAP >> 3, 255, np.uint8)
        import pyarrow as pa

        class Shared:
            value = (bitmap, {5: [decontam.size_class(16)]})

        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([b" ".join(words).decode()])], ["key", "digest", "text"])
        hits = np.concatenate([b.column("slot").to_numpy() for b in decontam._looked(Shared)(iter([batch]))])
        assert len(np.intersect1d(hits, slots)) > 0


def test_leaks_edge_cases(edge, empty, spark):
    items = spark.createDataFrame([(1, "no id here at all"), (2, None)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(edge, items).collect()] == [(None, 1)]
    assert decontam.leaks(empty, items).count() == 0
    assert decontam.leaks(edge, items.limit(0)).count() == 0
    kept = decontam.cleaned(edge, items)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in edge_texts()} - {None}


# Personal data


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


VALUES = {
    "card 4111-1111-1111-1111 end": "4111-1111-1111-1111", "pay 4111111111111111.": "4111111111111111", "iban DE89 3704 0044 0532 0130 00 ok": "DE89 3704 0044 0532 0130 00", "call +1 (319) 555-5132 now": "+1 (319) 555-5132",
    "home 212-555-0187": "212-555-0187", "ssn 123-45-6789, x": "123-45-6789", "ip 152.143.123.131 x": "152.143.123.131", "mail Jane.Doe7@mail7.example.com!": "Jane.Doe7@mail7.example.com", "on 2021-02-28, x": "2021-02-28", "am 28.2.2021 x": "28.2.2021", "on 12/31/1999 x": "12/31/1999",
}


def test_values_are_replaced_in_their_format(spark):
    docs = spark.createDataFrame(list(enumerate(VALUES)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymised(docs, "k").collect()}
    for i, (text, value) in enumerate(VALUES.items()):
        new = got[i]["text"]
        before, after = text.split(value)
        assert got[i]["n_values"] == 1 and value not in new and new.startswith(before) and new.endswith(after), (text, new)
        out = new[len(before) : len(new) - len(after)]
        if "card" in text or "pay" in text:
            digits = "".join(c for c in out if c.isdigit())
            assert luhn(digits) and len(out) == len(value) and digits[0] == "4"
        if "iban" in text:
            plain = out.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        if "ip " in text:
            assert all(0 <= int(x) < 256 for x in out.split("."))
        if text.startswith(("on", "am")):
            import datetime

            form = "%Y-%m-%d" if "-" in out else "%d.%m.%Y" if "." in out else "%m/%d/%Y"
            datetime.datetime.strptime(out, form)
        if "mail" in text:
            assert out.endswith("@mail7.example.com") and len(out) == len(value)


def test_equal_values_stay_linked_and_invalid_ones_stay(spark):
    card = "4111 1111 1111 1111"
    docs = spark.createDataFrame([(1, f"{card} and {card}"), (2, f"x {card}"), (3, "1234567890123456 999.1.1.1 2021-02-30 000-12-3456 v1.2.3.4.5"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymised(docs, "k").collect()}
    a, b = got[1]["text"].split(" and ")
    assert a == b == got[2]["text"][2:] and got[1]["n_values"] == 2
    assert got[3]["text"] == "1234567890123456 999.1.1.1 2021-02-30 000-12-3456 v1.2.3.4.5" and got[3]["n_values"] == 0
    assert got[4]["text"] is None and got[5]["text"] == ""
    other = pii.pseudonymised(docs, key="another").collect()
    assert {r["doc_id"]: r["text"] for r in other}[2] != got[2]["text"]


def test_networks_are_permutations(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    assert rows.select(pii.permuted(F.col("s"), "0123456789", "x", "k").alias("p")).distinct().count() == 1000
    days = spark.range(0, 60_000, 7).select(F.date_add(F.lit("1905-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    assert days.select(pii._moved_day(F.col("d"), "k").alias("m")).distinct().count() == days.count()
    valid = spark.range(3000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 600 + 1, F.col("id") % 90 + 1, F.col("id") + 1).alias("s")).where("s not like '666%'")
    new = valid.select(pii._ssn(F.col("s"), "k").alias("p"))
    assert new.where("p is null").count() == 0 and new.distinct().count() == valid.distinct().count()


def test_numbers_beside_others(spark):
    card, iban, phone = "4111111111111111", "DE89370400440532013000", "+1 (017) 555-7713"
    spaced = "4111 1111 1111 1111"
    texts = [card, f"{card} 25 items", f"order 12 {card} paid", f"{spaced} 25", f"{spaced} 5500 0000 0000 0004", iban, f"{iban} 2024", phone, f"{phone} 22"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs, "k").collect()}
    assert got[0] != card and luhn(got[0])
    assert got[1] == f"{got[0]} 25 items" and got[2] == f"order 12 {got[0]} paid"
    assert got[3][-3:] == " 25" and got[3][:-3].replace(" ", "") == got[0] and got[4].startswith(got[3][:-3] + " ") and "5500 0000" not in got[4]
    assert got[5] != iban and got[6] == f"{got[5]} 2024"
    assert got[7] != phone and got[8] == f"{got[7]} 22"


def test_phones_end_by_country(spark):
    """A number after a phone stays, and equal phones have equal pseudonyms beside it."""
    phones = ["+49 30 1234567", "+49 (30) 1234567", "+44 20 7946 0958", "+33 1 23 45 67 89", "+4930123456", "+48-601-234-567", "+43 1 58858", "+61 2 9876 5432", "+353 87 1234567"]
    docs = spark.createDataFrame([(2 * i + j, p + end) for i, p in enumerate(phones) for j, end in enumerate(["", " 12 apples"])], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs, "k").collect()}
    for i, p in enumerate(phones):
        if len("".join(c for c in p if c.isdigit())) < 8:
            assert got[2 * i] == p
            continue
        assert got[2 * i] != p and got[2 * i + 1] == got[2 * i] + " 12 apples"
        assert [c if c.isdigit() else 0 for c in p].count(0) == [c if c.isdigit() else 0 for c in got[2 * i]].count(0) and len(p) == len(got[2 * i])


def test_emails_of_any_letters(spark):
    docs = spark.createDataFrame([(0, "to jöhn@x.org now"), (1, "JÖHN@x.org"), (2, "jahn@x.org"), (3, "Ωmega.ß@x.org")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs, "k").collect()}
    assert got[0].startswith("to ") and got[0].endswith("@x.org now") and not set("jöhn") & set(got[0][3:-10]) - set("0123456789abcdef") and got[1] == got[0][3:-4]
    assert got[2] != "jahn@x.org" and len(got[2]) == 10 and "mega" not in got[3] and got[3].endswith("@x.org")


def test_walks_go_on_until_valid(spark, monkeypatch):
    monkeypatch.setattr(pii, "WALKS", 1)
    rows = spark.range(200).select(F.lpad((F.col("id") * 5).cast("string"), 3, "0").alias("s"))
    new = rows.select(pii.walked(F.col("s"), lambda x: pii.permuted(x, "0123456789", "x", "k"), lambda x: x.rlike("[05]$")).alias("p"))
    assert {r["p"] for r in new.collect()} == {r["s"] for r in rows.collect()}


def test_pii_edge_cases(edge, empty):
    got = pii.pseudonymised(edge, "k")
    assert got.columns == [*edge.columns, "n_values"] and got.count() == edge.count()
    same = {(r["doc_id"], r["text"]) for r in edge.collect()}
    assert all((r["doc_id"], r["text"]) in same for r in got.collect() if r["n_values"] == 0)
    assert pii.pseudonymised(empty, "k").count() == 0


# I-Match




@pytest.mark.parametrize("part_rows", [2_000, 7])
def test_imatch_matches_definition(spark, part_rows, monkeypatch):
    monkeypatch.setattr(imatch, "PART_ROWS", part_rows)
    rng = random.Random(6)
    rows = [(i * 3, prose(rng, rng.randint(0, 60)) + f" u{i % 9} é½") for i in range(40)] + [(1000, None), (1001, ""), (1002, "Ünï " * 9), (1003, "Ünï " * 9)]
    got = {r["doc_id"]: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), share=0.9).collect()}
    assert len(got) == len(rows)
    rows.sort()
    prints = {}
    for i, (key, text) in enumerate(rows):
        own, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        quarter = len(own) // 4
        edited = own[: len(own) - quarter] + following[:quarter]
        r = got[key]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(own, set()).add(r["fingerprint"])
        if edited == own:
            assert r["near_edited"] == 1.0
        if following == own:
            assert r["near_next"] == 1.0
    assert all(len(p) == 1 for p in prints.values())


@pytest.mark.parametrize("text", ["one two three\nfour five", "abcdefgh", "abc\n", "a b c d e f\n\n", "x" * 200_000 + " end", "één twee drië vier"])
def test_imatch_terms_of_both_texts(spark, text):
    """The edit falls within words, after line breaks, in one long word: the edited text's fingerprint is that of the same text by itself."""
    own, after = text, "seven eight nine ten eleven"
    edited = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
    rows = [(0, own), (1, after), (2, edited), (3, edited + " more"), (4, own + " more"), (5, "seven eight nine"), (6, "seven eight nin"), (7, "sev"), (8, "seven eigh"), (9, "s")]
    got = {r["doc_id"]: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), share=1.0).collect()}
    assert got[0]["edited_fingerprint"] == got[2]["fingerprint"]


def test_imatch_signatures_match_brute_force(spark):
    """Whole term sets, band, lexicons, signatures and likeness computed once more from the terms' hashes."""
    rng = random.Random(9)
    words = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(rng.sample(words, rng.randint(5, 90)))) for i in range(50)]
    rows += [(50 + i, rows[7][1]) for i in range(40)]  # copies count once
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs, share=0.6).collect()}
    df = Counter(w for t in {t for _, t in rows} for w in set(t.split()))
    band = {w for w, c in df.items() if 2 <= c <= 30}
    hashes = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h"))
    hashes = {r["w"]: (r["h"], [g % (1 << 64) for g in r["g"]]) for r in hashes.select("w", "h", F.array(*[F.xxhash64("h", F.lit(100 + j)) for j in range(imatch.SUBSETS // 4)]).alias("g")).collect()}

    def chained(own):
        """XXH64 of the terms in order, each seeded by the one before."""
        out = 42
        for h in sorted(own):
            out = xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), out)
        return out if own else 0

    def brute(text):
        own = [hashes[w] for w in set(text.split()) & band]
        if not own:
            return None
        at = max(1, int(np.log(len(own)) / np.log(4) + 0.5))
        sigs = [chained([h for h, g in own if (g[j // 4] >> 16 * (j % 4)) % 4**k == 0]) for k in (at, at + 1) for j in range(imatch.SUBSETS)]
        return at, sigs, "l%d." % at + ".".join(f"{x:016x}" if x else "" for x in [chained([h for h, _ in own]), *sigs])

    def like(a, b):
        if a[2] == b[2]:
            return 1.0
        if abs(a[0] - b[0]) > 1:
            return 0.0
        n = imatch.SUBSETS
        x, y = (a[1], b[1]) if a[0] == b[0] else (a[1][n:], b[1][:n]) if a[0] < b[0] else (a[1][:n], b[1][n:])
        seen = [(i, j) for i, j in zip(x, y) if i or j]
        return sum(i == j for i, j in seen) / len(seen) if seen else 0.0

    for i, text in rows:
        own, following = brute(text), rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        new = text[: len(text) - cut] + following[:cut]
        r = got[i]
        assert r["fingerprint"] == own[2]
        assert r["near_next"] == pytest.approx(like(own, brute(following)))
        if set(new.split()) <= set(words):
            assert r["edited_fingerprint"] == brute(new)[2] and r["near_edited"] == pytest.approx(like(own, brute(new)))
    assert len({got[i]["fingerprint"] for i in range(50)}) == 50


def test_imatch_band_goes_by_frequency_alone(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 50 + 1))) for i in range(50)], "doc_id long, text string")
    assert imatch.lexicon(docs, share=1.0).count() == 49 and imatch.lexicon(docs, share=0.5).count() == 24 and imatch.lexicon(docs, least=10, share=1.0).count() == 41


def test_imatch_band_of_any_size(spark, monkeypatch):
    """A band that is joined by shuffle gives what a broadcast one does."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(0, 60)) + f" u{i % 9}") for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, imatch.fingerprints(docs, share=0.9).collect()))
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, imatch.fingerprints(docs, share=0.9).collect())) == want


def test_imatch_moves_texts_once(spark):
    """Terms are gathered where their texts are: of the documents, only their order needs a shuffle, and terms are cut once a text."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(40)], "doc_id long, text string")
    found = imatch.banded(docs, F.broadcast(imatch.lexicon(docs, share=0.9)))
    assert found.count() == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("split(") == 2


def test_imatch_order_of_terms(spark):
    """Neither the order nor the repetition of terms counts; sets with an equal exclusive or differ."""
    docs = spark.createDataFrame([(0, "alpha beta gamma"), (1, "gamma, ALPHA beta beta"), (2, "alpha"), (3, "alpha x"), (4, "beta"), (5, "y")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs, share=1.0).collect()}
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1.0
    assert got[2]["fingerprint"] == got[3]["fingerprint"] != got[4]["fingerprint"] and len(got[2]["fingerprint"].split(".")[1]) == 16
    assert got[5]["fingerprint"].startswith("t.")
    a, b = (F.array(*[F.lit(x).cast("long") for x in y]) for y in ((1, 2, 3), (5, 5, 0)))
    r = spark.range(1).select(imatch.signature(a).alias("a"), imatch.signature(b).alias("b")).first()
    assert r["a"] != r["b"]


@pytest.mark.parametrize("keys", [[10**17, *range(60)], [1] * 30 + list(range(30)), [None] * 20 + list(range(40)), [2**i for i in range(62)]])
def test_imatch_skewed_keys(spark, monkeypatch, keys):
    """Far-off, equal and null keys: parts stay small as far as keys differ, and every document has its next."""
    monkeypatch.setattr(imatch, "PART_ROWS", 5)
    docs = spark.createDataFrame([(k, f"w{i} w{i + 1} text {i}") for i, k in enumerate(keys)], "doc_id long, text string").repartition(3)
    sizes = [r["count"] for r in imatch.parted(docs, "doc_id").groupBy("part").count().collect()]
    most = max(Counter(keys).values())
    assert max(sizes) <= max(12, most + 12) and len(sizes) > 4
    rows = imatch.edited(docs).select("key", "digest", "next_key", "next_digest").collect()
    order = lambda k: (k is not None, k or 0)
    ring = sorted(((r["key"], r["digest"]) for r in rows), key=lambda x: (order(x[0]), x[1]))
    following = dict(zip(ring, ring[1:] + ring[:1]))
    assert len(rows) == len(keys) and all(following[r["key"], r["digest"]] == (r["next_key"], r["next_digest"]) for r in rows)


def test_imatch_edge_cases(edge, empty, spark):
    got = imatch.fingerprints(edge).collect()
    assert len(got) == edge.count()
    assert imatch.fingerprints(empty).count() == 0
    one = spark.createDataFrame(rows_of([(1, "only one", "en", "a")]), SCHEMA)
    r = imatch.fingerprints(one).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 8
