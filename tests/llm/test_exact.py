"""Operators against brute-force versions and round trips."""

import collections
import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from arcweft.llm import common, fingerprint, html_extract, jpeg, langid, mixing, packing, pii, simhash, suffix_dedup, toxicity


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


# ---- mixing


def test_targets_share_the_budget(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    got = mixing.mix_sizes(docs(spark, rows)).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sizes(docs(spark, rows[::-1])).collect()}
    assert all(again[r["doc_id"]] == r["taken"] for r in got)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(x for x in size if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(size.values()), {}, set(names)
    while free:  # share, cut off at twice the size, share again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= over
    taken = collections.Counter()
    by_source = {i: s for i, _, s in rows}
    for r in got:
        s = by_source[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == size[s] and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 130 for s in names) and sum(taken.values()) <= 1.5 * sum(size.values())


def test_mixed_documents_repeat(spark):
    rows = [(i, "w " * 10, "big" if i else "small") for i in range(12)]
    got = collections.Counter(r["doc_id"] for r in mixing.mix_documents(docs(spark, rows)).collect())
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sizes(docs(spark, rows)).collect()}
    assert got == {i: n // 10 for i, n in taken.items() if n}


def test_copies_of_a_document_share_their_passes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i // 4, f"{'w ' * 9}{i // 4}", "a" if i % 200 else "b") for i in range(400)] + [(None, "n " * 10, "a")] * 30 + [(7, "other text of one id " + str(i), "a") for i in range(20)]
    for salted in (mixing.SALTED, 3):
        monkeypatch.setattr(mixing, "SALTED", salted)
        table = docs(spark, rows)
        taken = sum(r["taken"] for r in mixing.mix_sizes(table).collect())
        got = mixing.mix_documents(table.selectExpr("*", "1 as key", "2 as k", "3 as s", "4 as p", "5 as start")).collect()
        assert taken == sum(len(r["text"].split()) for r in got) > 0
        per = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in got)
        have = collections.Counter((i, t, s) for i, t, s in rows)
        assert all(n <= 2 * have[k] for k, n in per.items())


def test_some_copies_are_sent_once(spark):
    rows = [(1, "a " * 10, s) for s in "abc" for _ in range(10)]
    got = collections.Counter(r["source"] for r in mixing.mix_documents(docs(spark, rows)).collect())
    taken = collections.Counter()
    for r in mixing.mix_sizes(docs(spark, rows)).collect():
        taken[round(r["target"])] += r["taken"]
    assert got["c"] < 10 < got["b"] < got["a"] == 20 and sorted(taken.values()) == sorted(10 * n for n in got.values())


# ---- fingerprints


def test_likeness_is_exact(spark):
    rng = random.Random(2)
    rows = [(i * 3, "\n".join(prose(rng, rng.randint(1, 9)) + "." for _ in range(rng.choice([0, 1, 5, 40, 300]))), "s") for i in range(40)]
    rows.append((500, rows[0][1], "s"))
    texts = {i: t for i, t, _ in rows}
    order = sorted(texts, reverse=True)
    pieces = lambda t: {p for p in re.split(r"\n|(?<=[.!?]) ", t) if p}
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    got = {r["doc_id"]: r for r in fingerprint.compare_versions(docs(spark, rows)).collect()}
    for k, i in enumerate(order):
        t, n = texts[i], texts[order[(k + 1) % len(order)]]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == pytest.approx(like(pieces(t), pieces(e))) and got[i]["near_next"] == pytest.approx(like(pieces(t), pieces(n)))
    assert got[0]["fingerprint"] == got[500]["fingerprint"]


def test_ranges_do_not_matter(spark):
    rows = [(i, f"text {i}. more {i % 3}.", "s") for i in range(50)]
    one = fingerprint.with_next(docs(spark, rows)).select("doc_id", "next_text").collect()
    many = fingerprint.with_next(docs(spark, rows), rows_per_range=4).select("doc_id", "next_text").collect()
    assert sorted(one) == sorted(many)


def xx(value, seed=42):
    return xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed)


class Sketch:
    """A fingerprint read back from its text."""

    def __init__(self, text):
        n, _, cells = text.partition(":")
        self.n = int(n)
        cells = [(int(c.split(".")[0]), int(c.split(".")[1], 16)) if c else (0, 0) for c in cells.split(" ")]
        self.tables = [cells[i : i + 40] for i in range(0, len(cells), 40)]


def cells_of(digest, bits):
    word, first = (digest, 49) if bits == 3 else (xx(digest, 1), 0)
    return [(t << bits) + (word >> first + bits * t & (1 << bits) - 1) for t in range(5)]


def enter(digests, bits):
    table = [(0, 0)] * (5 << bits)
    for d in digests:
        for c in cells_of(d, bits):
            table[c] = (table[c][0] + 1, table[c][1] ^ d)
    return table


def peel(table, bits=3):
    """Digests found, and how many are stuck."""
    table, found = list(table), []
    while True:
        pure = {(n, k) for i, (n, k) in enumerate(table) if abs(n) == 1 and xx(k >> 24) & 0xFFFFFF == k & 0xFFFFFF and i in cells_of(k, bits)}
        if not pure:
            break
        for n, k in pure:
            for c in cells_of(k, bits):
                table[c] = (table[c][0] - n, table[c][1] ^ k)
        found += pure
    return [k for _, k in found], -(-sum(max(abs(n), 2) for n, k in table if n or k) // 5)


def minus(a, b):
    return [(x[0] - y[0], x[1] ^ y[1]) for x, y in zip(a, b, strict=True)]


def near(a, b):
    """Likeness of two fingerprints by nothing but their texts."""
    small, large = sorted((Sketch(a), Sketch(b)), key=lambda s: len(s.tables))
    differ, spread = 0, small.tables
    if len(small.tables) < len(large.tables):
        own = [peel(t) for t in small.tables]
        differ = sum(left for _, left in own)
        spread = [[] for _ in large.tables]
        for found, _ in own:
            for d in found:
                spread[d >> 24 & len(spread) - 1].append(d)
        spread = [enter(ds, 3) for ds in spread]
    for x, y in zip(large.tables, spread, strict=True):
        found, left = peel(minus(x, y))
        if left:
            (fx, lx), (fy, ly) = peel(x), peel(y)
            if not lx + ly:
                found, left = peel(minus(enter(fx, 5), enter(fy, 5)), 5)
        differ += len(found) + left
    n = small.n + large.n
    return max(0.0, (n - differ) / (n + differ)) if n else 1.0


def test_likeness_of_fingerprints_alone(spark):
    rng = random.Random(21)
    base = [prose(rng, 6) + "." for _ in range(400)]
    rows = []
    for i in range(60):
        lines = rng.sample(base, rng.choice([0, 1, 3, 9, 30, 90, 300])) if i % 2 else rows[-1][1].split("\n") if rows else []
        if lines and i % 2 == 0:
            lines[rng.randrange(len(lines))] = prose(rng, 5)
        rows.append((i, "\n".join(lines), "s"))
    got = {r["doc_id"]: r for r in fingerprint.compare_versions(docs(spark, rows)).collect()}
    for i in got:
        assert got[i]["near_edited"] == pytest.approx(near(got[i]["fingerprint"], got[i]["edited_fingerprint"]))
        assert got[i]["near_next"] == pytest.approx(near(got[i]["fingerprint"], got[(i - 1) % len(rows)]["fingerprint"]))
    assert any(len(Sketch(r["fingerprint"]).tables) > 16 for r in got.values())


def test_sketches_recover_differences(spark):
    for n in (1, 3, 12, 60, 1000):
        pairs = spark.range(1).selectExpr(f"transform(sequence(1, {n}), x -> concat('p', x)) as a", f"transform(sequence({n // 2 + 1}, {n // 2 + n}), x -> concat('p', x)) as b")
        pairs = pairs.selectExpr(f"{fingerprint.digests('array_join(a, chr(10))')} as a", f"{fingerprint.digests('array_join(b, chr(10))')} as b")
        pairs = pairs.selectExpr(f"{fingerprint.sketches('a')} as a", f"{fingerprint.sketches('b')} as b", f"{n} as n")
        assert fingerprint.add_likeness(pairs, "near", "a", "n", "b", "n").first()["near"] == pytest.approx((n - n // 2) / (n + n // 2))


def test_null_ids_follow_by_hash_in_many_ranges(spark):
    rows = [(None, f"text {i}.", "s") for i in range(60)] + [(7, "x", "s"), (9, "y", "s")]
    one = fingerprint.with_next(docs(spark, rows)).select("doc_id", "text", "next_text").collect()
    many = fingerprint.with_next(docs(spark, rows), rows_per_range=8).select("doc_id", "text", "next_text").collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and {r["text"]: r["next_text"] for r in one}["y"] == "x"


# ---- HTML


def test_article_without_the_rest():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="page"><header><h2>Site</h2></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies, really, we do.</div><div id="main-content"><div class="post"><h1>The  title &amp; more</h1><p>First, long paragraph, with commas, and text &lt;here&gt;.<br>Same block.</p>
    <ul><li>An item, kept</li><li>Another</li></ul><p>Second paragraph with a <a href="#">link</a> inside.</p><form><p>Sign up</p></form><aside>Related stories, many of them, all linked.</aside></div></div>
    <div class="comments"><p>A reader, commenting, at length, about everything, and more.</p></div><div class="sidebar"><p>Side, side, side, side.</p></div><script>var p="</p>";</script><footer>&copy; Foot</footer></body></html>"""
    assert html_extract.extract(page) == "The title & more\nFirst, long paragraph, with commas, and text <here>. Same block.\nAn item, kept\nAnother\nSecond paragraph with a link inside."


def test_wrappers_named_like_parts_of_a_page():
    body = "<h1>Head</h1><p>First text, of the page.</p><p>Second text, a little longer.</p>"
    text = "Head\nFirst text, of the page.\nSecond text, a little longer."
    side = "<div class='sidebar-content'><p>More, more, more.</p></div><div class='comments-main'><p>I say, no.</p></div>"
    assert html_extract.extract(f"<form id=aspnet><div class='content-with-sidebar'>{body}</div>{side}</form>") == text
    assert html_extract.extract(f"<div id=page>{body}<form><p>Subscribe now</p></form>{side}</div>") == text


LONG = " ".join(f"Sentence {i} of the story goes on, with commas, for a while." for i in range(12))


@pytest.mark.parametrize("name", ["layout with-sidebar", "has-ads", "fixed-header", "legal", "search-page"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_names_of_wrappers_do_not_empty_a_page(name, inner):
    page = f"<body><div class='{name}'><{inner}><h1>Title</h1><p>{LONG}</p></{inner}><div class='sidebar'><p>Side note, short.</p></div></div></body>"
    assert html_extract.extract(page) == f"Title\n{LONG}"


def test_linked_blocks_of_an_article_stay():
    page = f"<body><h1>Page title</h1><div id='content'><h2><a href='x'>Linked headline</a></h2><p>{LONG}</p><p><a href='y'>All of it a link</a></p><p>{LONG}</p><ul><li><a href='1'>One</a></li><li><a href='2'>Two</a></li></ul></div></body>"
    assert html_extract.extract(page).split("\n") == ["Page title", "Linked headline", LONG, "All of it a link", LONG]


def test_long_attributes_and_deep_menus():
    data = "{" + "a > b, " * 2000 + "}"
    page = f"<article><p data-json='{data}'>{LONG}</p></article>"
    assert html_extract.extract(page) == LONG
    page = "<div>" * 450 + f"<nav><div><p>Menu entry of the page</p></div></nav><p>{LONG}</p>" + "</div>" * 450
    assert html_extract.extract(page) == LONG


def test_what_stands_inside_an_article():
    page = f"<article><h2><a href=x>Linked head</a></h2><p class='legal'>The law, in short.</p><p class='related'>A related matter.</p><ul><li>Plain</li><li><a href=y>Linked</a></li></ul><p>{LONG}</p><div class='related'><p>More to read.</p></div><p class='ad'>Buy now.</p></article>"
    assert html_extract.extract(page).split("\n") == ["Linked head", "The law, in short.", "A related matter.", "Plain", "Linked", LONG]
    page = f"<article><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds, press <button>OK</button> to go <span hidden>unseen</span>on.</p></article>"
    assert html_extract.extract(page).split("\n") == [LONG, "So x=2 holds, press to go on."]
    assert html_extract.extract(f"<article><p>Choose <select><option>A<option>B</select> here, then read on.</p><p>{LONG}</p></article>").split("\n")[0] == "Choose here, then read on."


def plain_article(page):
    """The blocks of the only article of a page, by splitting at tags alone."""
    inside = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
    inside = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inside, flags=re.S)
    blocks = re.split(r"</?(?:p|h[1-6]|div|section|ul|ol|li|blockquote|pre)\b[^>]*>", inside)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables are not here")
def test_all_pages_against_splitting(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(rows) == len(got) > 100 and all(got[r["page_id"]] == plain_article(r["html"]) for r in rows)


def test_page_without_structure():
    assert html_extract.extract("<div>One block,\n of &nbsp; text</div>") == "One block, of text"
    assert html_extract.extract("<nav><a href=x>Menu</a></nav>") == ""


# ---- packing


def brute_place(pieces, capacity, bits):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [b for b in bins if b["left"] >= size and cluster not in b["clusters"] and b["sources"][source] < bits.get(source, 1)]
        b = min(fits, key=lambda b: (b["left"], b["id"]), default=None)
        if b is None:
            b = {"left": capacity, "clusters": set(), "sources": collections.Counter(), "n": 0, "id": len(bins)}
            bins.append(b)
        out.append((b["id"], b["n"]))
        b["left"] -= size
        b["n"] += 1
        b["clusters"].add(cluster)
        b["sources"][source] += 1
    return out


def test_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(30):
        pieces = sorted(((rng.randint(1, 100), rng.randint(0, 4), rng.randint(0, 40)) for _ in range(200)), reverse=True)
        bits = {0: 3, 1: 2}
        assert packing.place(pieces, 100, bits) == brute_place(pieces, 100, bits)


def test_packing_keeps_every_word(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 300)) if i % 9 else "the same text", rng.choice("aab")) for i in range(300)]
    got = packing.pack(docs(spark, rows), capacity=128, block_rows=64).collect()
    words = collections.Counter()
    filled, texts = collections.Counter(), collections.defaultdict(list)
    for r in got:
        words[r["doc_id"]] += r["size"]
        if r["sequence"]:
            filled[r["sequence"]] += r["size"]
            texts[r["sequence"]].append((dict((i, t) for i, t, _ in rows)[r["doc_id"]], r["piece"]))
    assert words == {i: len(t.split()) for i, t, _ in rows} and max(filled.values()) <= 128
    assert all(len({t for t, _ in v}) == len(v) for v in texts.values())


def test_short_texts_of_one_source_fill_sequences(spark):
    rows = [(i, f"a{i} b{i} c{i}", "s") for i in range(4000)]
    got = packing.pack(docs(spark, rows)).collect()
    full = collections.Counter()
    for r in got:
        full[r["sequence"]] += r["size"]
    assert sum(full.values()) == 12_000 and max(full.values()) <= packing.CAPACITY
    assert len(full) == 6 and sorted(full.values())[1] > 0.95 * packing.CAPACITY


def test_named_clusters(spark):
    rows = docs(spark, [(i, f"w{i}", "s") for i in range(40)]).selectExpr("*", "if(doc_id < 2, 'c', null) as c", "1 as cluster")
    got = {r["doc_id"]: r["sequence"] for r in packing.pack(rows, cluster="c").collect()}
    assert len(set(got.values())) == 2 and got[0] != got[1]
    assert len({r["sequence"] for r in packing.pack(rows).collect()}) == 1


# ---- personal data


def test_pseudonyms_link_and_stay_valid(spark):
    card, ip, mail = "4111111111111111", "10.20.30.40", "jo.doe42@mail.example.com"
    rows = [(1, f"{card} {ip}, {mail}", "s"), (2, f"x {mail} y {card}!! {ip}.", "s"), (3, "4111111111111112 999.1.1.1 2023-02-30 000-12-3456 1.2.3.4.5", "s"), (4, "2023-02-28 123-45-6789 (212) 555-0100", "s")]
    got = {r["doc_id"]: r for r in pii.pii_report(docs(spark, rows), "k1").collect()}
    a, b = re.findall(r"\d{16}", got[1]["text"]), re.findall(r"\d{16}", got[2]["text"])
    digits = [int(c) for c in a[0][::-1]]
    assert a == b and a[0] != card and (sum(digits[::2]) + sum(sum(divmod(2 * c, 10)) for c in digits[1::2])) % 10 == 0
    assert re.search(r"\S+@mail\.example\.com", got[1]["text"])[0] == re.search(r"\S+@mail\.example\.com", got[2]["text"])[0] != mail
    assert got[3]["text"] == rows[2][1] and got[3]["n_replaced"] == 0
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d{3}-\d\d-\d{4} \(\d{3}\) \d{3}-\d{4}", got[4]["text"]) and got[4]["n_replaced"] == 3
    assert {r["doc_id"]: r for r in pii.pii_report(docs(spark, rows), "other").collect()}[1]["text"] != got[1]["text"]


def plain_feistel(values, limits, kind, key):
    v, half = list(values), len(values) // 2
    for r in range(pii.ROUNDS):
        other = ",".join(map(str, v[half:] if r % 2 == 0 else v[:half]))
        mine = range(half) if r % 2 == 0 else range(half, len(v))
        new = list(v)
        for i in mine:
            new[i] = (v[i] + int(hashlib.sha256(f"{key}|{kind}|{r}|{i}|{other}".encode()).hexdigest()[:12], 16)) % limits[i]
        v = new
    return v


def test_pseudonyms_by_plain_python(spark):
    rng = random.Random(33)
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(40)]
    got = {r["doc_id"]: r["text"] for r in pii.pii_report(docs(spark, [(i, f"at {x} now", "s") for i, x in enumerate(ips)]), "k9").collect()}
    assert all(got[i] == "at " + ".".join(map(str, plain_feistel(list(map(int, x.split("."))), [256] * 4, "ip", "k9"))) + " now" for i, x in enumerate(ips))
    cards = []
    for _ in range(40):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        check = -sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(body[::-1])) % 10
        cards.append(f"{body}{check}")
    got = {r["doc_id"]: r["text"] for r in pii.pii_report(docs(spark, [(i, x, "s") for i, x in enumerate(cards)]), "k9").collect()}
    for i, x in enumerate(cards):
        body = "".join(map(str, plain_feistel(list(map(int, x[:15])), [10] * 15, "card", "k9")))
        assert got[i] == body + str(-sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(body[::-1])) % 10)


def test_feistel_is_a_permutation(spark):
    n = spark.range(1000).selectExpr(f"{pii.feistel('array(id div 10, id % 10)', 'array(100L, 10L)', 'x', 'k')} as p")
    assert n.distinct().count() == 1000
    days = spark.sql("select explode(sequence(date'2000-01-01', date'2009-12-31')) d").selectExpr("cast(d as string) t").selectExpr(f"{pii._pseudonym('t', 'k1')} as p")
    assert days.distinct().count() == days.count() == days.where("try_to_date(p, 'yyyy-MM-dd') is not null").count()


# ---- near duplicates


def test_simhash_components(spark):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        t = prose(rng, rng.choice([3, 40, 200]))
        rows.append((len(rows), t, "s"))
        for _ in range(rng.choice([0, 0, 1, 6])):
            w = rows[-1][1].split()
            w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.3 else " ".join(w), "s"))
    got = {r["doc_id"]: r for r in simhash.components(docs(spark, rows)).collect()}
    fps = {}
    for i, t, _ in rows:
        w = t.lower().split()
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
        fps[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
        assert got[i]["fingerprint"] == f"{fps[i]:016x}"
    group = {i: i for i in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    assert {i: r["component_id"] for i, r in got.items()} == {i: root(i) for i in fps}


def test_links_of_random_neighbours(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {simhash._signed(v) for b in base for v in [b] + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64) if rng.random() < 0.4 else 0) for _ in range(6)]}
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for paired in (simhash.PAIRED, 2):  # all members of a key, or a bit left open
        monkeypatch.setattr(simhash, "PAIRED", paired)
        got = {tuple(sorted(r)) for r in simhash.links(frame).collect()}
        assert got == {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_near_duplicates_of_shingles(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(60):
        w = prose(rng, 220).split()
        rows.append((len(rows), " ".join(w), "s"))
        for edits in (1, 3, 30):
            v = list(w)
            for k in rng.sample(range(220), edits):
                v[k] = "new" + str(k)
            rows.append((len(rows), " ".join(v), "s"))
    kept = {r["doc_id"] for r in simhash.without_near_duplicates(docs(spark, rows)).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(216)} for i, t, _ in rows}
    expect = set()
    for i in sorted(sets):
        same = [j for j in sets if j // 4 == i // 4 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        if i == min(same):
            expect.add(i)
    assert kept == expect


def test_near_copies_among_texts_with_a_passage(spark, monkeypatch):
    rng = random.Random(17)
    passage = prose(rng, 300)
    rows = []
    for i in range(150):
        own = prose(rng, 70).split()
        rows.append((2 * i, f"{passage} {' '.join(own)}", "a"))
        own[rng.randrange(10, 60)] = "zzz"
        own[rng.randrange(10, 60)] = "yyy"
        rows.append((2 * i + 1, f"{prose(rng, 4)} {passage} {' '.join(own)}", "a"))
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t, _ in rows}

    def alike(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    assert all(alike(2 * i, 2 * i + 1) for i in range(150)) and not any(alike(a, b) for a in range(300) for b in range(a) if a // 2 != b // 2)
    for size in (1024, 64):
        monkeypatch.setattr(simhash, "BLOCK_SETS", size, raising=False)
        kept = sorted(r["doc_id"] for r in simhash.without_near_duplicates(docs(spark, rows)).collect())
        assert kept == list(range(0, 300, 2))


def test_shared_hashes():
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(200), rng.randint(0, 120)) + ([1000 + i // 2] if i % 3 else [])) for i in range(90)]
    got = simhash.shared(np.array([x for s in sets for x in s], np.uint64), np.array([len(s) for s in sets]))
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets]


def test_one_of_a_large_group_stays(spark):
    rng = random.Random(9)
    w = prose(rng, 150).split()
    rows = [(i, " ".join([*w[:-1], f"tail{i}"]), "s") for i in range(1500)] + [(9000 + i, prose(rng, 50), "s") for i in range(20)]
    kept = sorted(r["doc_id"] for r in simhash.without_near_duplicates(docs(spark, rows)).collect())
    assert kept == [0] + [9000 + i for i in range(20)]


def shuffled(spark):
    """Bytes that each stage has written for others, by its number."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_texts_that_stay_are_not_sent(spark):
    rng = random.Random(21)
    words = prose(rng, 4000).split()
    rows = [(i, " ".join(rng.choices(words, k=4000)), "s") for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} more", "s") for i in range(6)] + [(2000, rows[7][1], "s"), (9, rows[9][1], "s")]
    frame = docs(spark, rows)
    before = max(shuffled(spark), default=-1)
    kept = sorted(r["doc_id"] for r in simhash.without_near_duplicates(frame).collect())
    assert kept == list(range(300))
    assert sum(n for stage, n in shuffled(spark).items() if stage > before) < sum(len(t) for _, t, _ in rows) / 4


@pytest.mark.parametrize("bits", [0.0001, 32])
def test_filters_flag_every_key(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "KEY_BITS", bits)
    monkeypatch.setattr(common, "BITMAP", 8 if bits < 1 else 32_768)
    frame = spark.createDataFrame([(i or None, i * i, f"x{i}") for i in range(4000)], "id long, at long, `a.b` string").repartition(5)
    for n in (0, 1, 1500):
        keys = frame.where(f"coalesce(id, 0) < {n}").select("id", "at")
        got = common.flagged(frame, ["id", "at"], keys, n, "hit")
        assert got.columns == ["id", "at", "a.b", "hit"] and got.count() == 4000
        hit = {r["at"] for r in got.where("hit").collect()}
        assert hit >= {i * i for i in range(n)} and (bits < 1 or len(hit) <= n + 4000 // 16)


def test_near_duplicates_by_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(common, "BITMAP", 8)
    monkeypatch.setattr(common, "FILTER_ROWS", 1)
    rng = random.Random(22)
    rows = [(i, prose(rng, 80), "s") for i in range(120)]
    rows += [(500 + i, f"{rows[i][1]} more", "s") for i in range(40)] + [rows[50], rows[50], rows[3], (None, rows[51][1], "s"), (None, "no id", "s"), (None, "no id", "s")]
    kept = [r["doc_id"] for r in simhash.without_near_duplicates(docs(spark, rows)).collect()]
    assert sorted(kept, key=lambda i: -1 if i is None else i) == [None, *range(120)]


# ---- repeated passages


def brute_removed(rows):
    seen, out = {}, {}
    for i, t in sorted((i, (t or "").encode()) for i, t, _ in rows):
        gone = bytearray(len(t))
        for a in range(len(t) - 49):
            if seen.setdefault(t[a : a + 50], i) < i:
                gone[a : a + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("common", [suffix_dedup.COMMON, 8])
def test_repeats_byte_by_byte(spark, common, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    rng = random.Random(10)
    base, line = prose(rng, 120), "a line that very many of the documents share. "
    rows = []
    for i in range(900):
        kind = rng.random()
        if kind < 0.3:
            t = prose(rng, rng.randint(0, 30)) + line + prose(rng, 15)
        elif kind < 0.6:
            a = rng.randrange(len(base) - 60)
            t = f"é{i} " + base[a : a + rng.randint(40, 200)] + f" ü{i}"
        elif kind < 0.7:
            t = " " * rng.randint(0, 140)
        elif kind < 0.75:
            t = None
        else:
            t = base[: rng.randint(45, 60)] + rng.choice("xyz") * rng.randint(0, 90)
        rows.append((i * 7 % 1000 + 1000 * (i * 7 // 1000), t, "s"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed(docs(spark, rows).repartition(3)).collect()}
    assert got == brute_removed(rows)


@pytest.mark.parametrize("several", [100, 0])
def test_repeats_of_rows_that_share_an_id(spark, several, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEVERAL", several, raising=False)
    rng = random.Random(12)
    lines = [prose(rng, 14) for _ in range(8)]
    rows = []
    for i in [1, 2, 3, 4, 4, 4, 5, None, None, None, None, None]:
        parts = [rng.choice(lines) if rng.random() < 0.5 else prose(rng, 9) for _ in range(rng.randint(1, 12))]
        rows.append((i, " ".join(parts), "a"))
    rows.append(rows[-1])
    least: dict = {}
    for i, t, _ in rows:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            least[w] = min(least.get(w, 1 << 40), 1 << 40 if i is None else i)
    want = []
    for i, t, _ in rows:
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < (1 << 40 if i is None else i):
                gone[k : k + 50] = [True] * 50
        rest = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        want.append((str(i), len(t), sum(gone), hashlib.sha256(rest.encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.removed(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want if x[0] == "None")


def test_suffix_arrays():
    rng = random.Random(11)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 40))] + [0]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_window_fallback_agrees(monkeypatch):
    rng = np.random.default_rng(1)
    contexts = rng.integers(97, 99, (60, suffix_dedup.CONTEXT)).astype(np.uint8)
    contexts[:, suffix_dedup.REACH : suffix_dedup.REACH + suffix_dedup.KEY] = 120
    contexts[30:] = contexts[:30]
    contexts[30:, 5] = 255
    ids, group = np.arange(60), np.zeros(60, np.int64)
    plain = suffix_dedup.repeated(contexts, ids, group)
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", 10)
    assert (plain == suffix_dedup.repeated(contexts, ids, group)).all() and plain.any() and not plain[:30].any()


# ---- JPEG


def test_jpeg_round_trip():
    rng = np.random.default_rng(2)
    payloads = [bytes(rng.integers(0, 256, 192 * n, dtype=np.uint8)) for n in (1, 2, 63, 64, 65, 200)] + [b"\xff" * 384, b"\x00" * 192]
    files = jpeg.encode(payloads)
    for p, f, (picture, coefs) in zip(payloads, files, jpeg.decode(files), strict=True):
        assert jpeg.payload_of(picture, coefs) == p and f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
        thumb = jpeg.thumbnail(picture, coefs)
        assert thumb.shape == (picture.rows, picture.cols) and picture.width == 8 * picture.cols


def hand_made(dc, ac, interval):
    """A small baseline file of one component, its scan written bit by bit: runs of zeros and ends of block."""
    counts = bytes([0, 0, 0, 12] + [0] * 12)
    symbols = bytes(range(8)) + bytes([0xF0, 0x21, 0x11, 0x33])
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + b"\x02" * 64) + jpeg._segment(0xC0, b"\x08\x00\x08\x00\x18\x01\x01\x11\x00")
    head += b"".join(jpeg._segment(0xC4, bytes([c << 4]) + counts + symbols) for c in (0, 1)) + jpeg._segment(0xDD, interval.to_bytes(2, "big")) + jpeg._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    code = {s: format(i, "04b") for i, s in enumerate(symbols)}

    def bits(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    scan, out, last = "", b"", 0
    for u, (d, a) in enumerate(zip(dc, ac, strict=True)):
        n, b = bits(d - last)
        last = d
        scan += code[n] + b
        k = 1
        for at, v in a:
            while at - k > 15:
                scan, k = scan + code[0xF0], k + 16
            n, b = bits(v)
            scan, k = scan + code[(at - k) << 4 | n] + b, at + 1
        if k < 64:
            scan += code[0]
        if interval and (u + 1) % interval == 0 or u + 1 == len(dc):
            raw = int((scan + "1" * (-len(scan) % 8)), 2).to_bytes(-(-len(scan) // 8), "big").replace(b"\xff", b"\xff\x00")
            out += raw + (bytes([0xFF, 0xD0 + u // interval % 8]) if interval and u + 1 < len(dc) else b"")
            scan, last = "", 0
    return head + out + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 2])
def test_jpeg_reader_handles_runs_and_intervals(interval):
    dc, ac = [5, -3, 60], [[(1, 1), (4, 1)], [(34, 1), (38, 7)], []]
    (picture, coefs), (other, more) = jpeg.decode([hand_made(dc, ac, interval), hand_made(dc[::-1], ac[::-1], interval)])
    assert coefs[:, 0, 0].tolist() == dc and more[:, 0, 0].tolist() == dc[::-1]
    for u, a in enumerate(ac):
        assert {k: int(coefs[u, 0, k]) for k in range(1, 64) if coefs[u, 0, k]} == dict(a)
    assert jpeg.thumbnail(picture, coefs).tolist() == [[129, 127, 143]] and (picture.width, picture.height) == (24, 8) and other.cols == 3


def test_media_columns(spark):
    rows = [(1, "é" * 96, "s"), (2, None, "s"), (3, "x" * 193, "s"), (4, "x" * 193, "s")]
    got = {r["doc_id"]: r for r in jpeg.media_columns(docs(spark, rows), keep_media=True).collect()}
    for i, t, _ in rows:
        payload = (t or "").encode()
        payload += b" " * (-len(payload) % 192 or (0 if payload else 192))
        r = got[i]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
    assert got[3]["feature"] == got[4]["feature"] and got[3]["media_sha256"] == got[4]["media_sha256"]


def test_files_that_cannot_be_read(spark):
    good = jpeg.encode([b"x" * 192 * n for n in (1, 3)])
    sub = good[0].replace(b"\x03\x01\x11\x00", b"\x03\x01\x22\x00")
    files = [good[0], None, b"", b"no picture", good[1][:200], good[0][:-30] + b"\xff\xd9", sub, good[1], bytes(500), b"\xff\xd8" + bytes(90)]
    table = spark.createDataFrame([(i, f, i) for i, f in enumerate(files)], "id int, media binary, width int")
    got = {r["id"]: r for r in jpeg.describe_media(table).collect()}
    assert got.keys() == set(range(10)) and [i for i in got if got[i]["readable"]] == [0, 7]
    assert got[7]["width_1"] == 24 and got[7]["height"] == 8 and len(got[7]["thumbnail"]) == 3 and got[3]["thumbnail"] is None and got[3]["width"] == 3


def test_language_by_brute_force(spark):
    rng = random.Random(31)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6))) for _ in range(20)), lang) for i in range(240) for lang in [rng.choice("abc") * 2]]
    table = spark.createDataFrame([(i, t, lang if i % 3 else None) for i, t, lang in rows], "doc_id long, text string, lang string")
    model = langid.learn(table)
    got = {r["doc_id"]: r for r in langid.identify(table, model).collect()}
    for i, t, lang in rows:
        v = langid.counts([t.encode()])[0].astype(np.float64) * model.idf
        cos = [float(v @ c / np.linalg.norm(v)) for c in model.vectors.astype(np.float64)]
        best = max(range(len(cos)), key=lambda k: cos[k])
        assert got[i]["lang_pred"] == model.langs[model.owner[best]] == lang and got[i]["score"] == pytest.approx(cos[best], abs=1e-5)


def test_toxicity_by_brute_force(spark):
    rng = random.Random(32)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) + (" vile thing" if i % 3 == 0 else "") for i in range(300)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    idx, val, bias = model = toxicity.train(table, labels)
    weight = dict(zip(idx.tolist(), val.tolist(), strict=True))
    for r in toxicity.score(table, model).collect():
        own = set(toxicity.features([texts[r["doc_id"]].encode()])[0].tolist())
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(bias + sum(weight.get(k, 0.0) for k in own)))), abs=1e-5)
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
