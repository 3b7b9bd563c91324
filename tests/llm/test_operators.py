"""Every operator of the folder against a plain version of itself, on small and awkward inputs."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import decontamination, fingerprints, html_text, language_model, mixing, pii, quality, sharding, simhash, suffixes
from tarn.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot string, key string, fp string, n long, low long, block string, extra int"


def word(rng):
    return "".join(rng.choice(["th", "er", "on", "an", "re", "ou", "é", "st"]) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


def awkward(seed=3):
    """Null, empty, blank, short and long texts, copies, near copies, repeated rows, null ids and sources."""
    rng = random.Random(seed)
    long = prose(rng, 6000)
    passage = prose(rng, 90)
    texts = [None, "", " \n\t", "one", "one two", long, long, long[:20000], passage * 3, "a" * 3000, "x\ny\n" * 400]
    texts += [prose(rng, rng.randint(5, 120)) for _ in range(30)]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(8)]
    texts += [texts[-1], texts[15], texts[15].upper(), texts[16] + "!"]
    rows = [(i * 3 % 200, t, rng.choice(["src0", "src1", "é", "", None])) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "one two", None), (None, texts[30], "src0"), (-5, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


def frame(spark, rows):
    full = [(i, t, "en", s, len(t or ""), 1, "s", "k", "f", 2, 3, "b", 4) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- 1 ---------------------------------------------------------------------------------------------


def test_masks_hit_every_copy_with_a_fifth_of_its_tokens_substituted():
    for n in (15, 16, 18, 20):
        for changed in itertools.combinations(range(n), n // 5):
            left = set(range(n)) - set(changed)
            assert any(all(o + p in left for p in m) for m in decontamination.MASKS for o in range(n - m[-1]))
    for n in range(5, 15):
        for changed in itertools.combinations(range(n), n // 5):
            left = set(range(n)) - set(changed)
            assert any(all(o + p in left for p in m) for m in decontamination.SHORT_MASKS for o in range(n - m[-1]))
    assert all(m != tuple(range(len(m))) for m in decontamination.MASKS)


def leaks_of(text, item):
    a, b = decontamination.tokens(text or ""), decontamination.tokens(item)
    best = 0
    for first in range(-len(b) + 1, len(a)):
        low, high = max(first, 0), min(len(a), first + len(b))
        same = np.array([a[i] == b[i - first] for i in range(low, high)])
        got = decontamination.verified(same, len(b)) if high - low >= 5 else None
        best = max(best, got[0] if got else 0)
    return best


def test_leaked_items(spark, docs, rows, none):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (15, 20, 60, 80)] + [" ".join(f"q{n}x{k}" for k in range(n)) for n in (5, 6, 11)] + [" ".join(rows[15][1].split()[:30]), "too short an item", None, ""]

    def changed(item, k):
        words = item.split()
        for i in rng.sample(range(len(words)), k):
            words[i] = "zzz"
        return " ".join(words)

    planted = [(1000 + i, prose(rng, 30) + " " + t + " " + prose(rng, 9), "src0") for i, t in enumerate(
        [items[0], changed(items[0], 3), changed(items[1], 4), changed(items[2], 12), changed(items[1], 9), " ".join(items[3].split()[:40]), items[2].upper(),
         changed(items[4], 1), changed(items[5], 1), changed(items[6], 2), changed(items[6], 3)])]
    every = rows + planted
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items + [items[1]])], "item_id long, text string, doc_id int")
    want = Counter()
    for doc_id, text, _ in every:
        for i, item in enumerate(items):
            if item and len(decontamination.tokens(item)) >= 5 and leaks_of(text, item):
                want[(doc_id, i, leaks_of(text, item))] += 1
    full = frame(spark, every)
    for block in (decontamination.BLOCK_TOKENS, 20):
        assert collected(decontamination.leaked_items(full, table, block), "doc_id", "item_id", "matched") == want
    found = {k[0] for k in want}
    assert {1000, 1001, 1002, 1003, 1005, 1006, 1007, 1008, 1009} <= found and not found & {1004, 1010}
    for block in (decontamination.BLOCK_TOKENS, 100):
        kept = decontamination.without_leaks(full, table, block)
        assert kept.columns == full.columns
        assert collected(kept, "doc_id", "text") == Counter((i, t) for i, t, _ in every if not any(leaks_of(t, x) for x in items if x and len(decontamination.tokens(x)) >= 5))
    assert decontamination.leaked_items(none, table).count() == 0
    assert decontamination.leaked_items(full, table.limit(0)).count() == 0
    assert decontamination.without_leaks(full, table.limit(0)).count() == len(every)


# --- 2 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<html></html>", ""), ("<nav><a href='/'>Only a menu</a></nav>", ""),
    ("<article><h1>T&amp;C</h1><p>One  two\nthree<br>four<p>Five &eacute;<script>var a='</p>'</script></article><footer>x</footer>", "T&C\n\nOne two three four\n\nFive é"),
    ("<body><nav>m</nav><article><p>Alpha beta gamma delta.</p><div class='ad-slot'>Buy</div><p>Epsilon zeta eta theta.</p><div id='comments'><p>First! I was here before all of you</p></div></article>",
     "Alpha beta gamma delta.\n\nEpsilon zeta eta theta."),
    ("<div class=cookie-banner>We use cookies</div><div class='post-content'><p>Words that matter here.</p><form><p>Your name</p></form><ul><li>a b c<li>d e f</ul></div><aside>More</aside>", "Words that matter here.\n\na b c\n\nd e f"),
    ("<article><p>unclosed <b>bold <i>text here", "unclosed bold text here"),
    ('<article><p class="x>Lost in the value">Kept words of a page</p><p title="stray>and the end', "Kept words of a page\n\nand the end"),
    ("<main><h1>Title words</h1><div class='byline share'>Tweet</div><p>Some text with a <a href='/x'>link in it</a>.</p><section id=comment-list><p>Nice post, thanks</p></section></main><div role=contentinfo>All rights reserved</div>",
     "Title words\n\nSome text with a link in it."),
    ("<body><div role='alert'>Outage today</div><div id=content><p>Line one of the text.</p><table><tr><td>Cell a</td><td>Cell b</td></tr></table><pre>x\n  y</pre></div><div id=sidebar><p>Popular now</p></div><div class=newsletter-signup><p>Get mail from us</p></div></body>",
     "Line one of the text.\n\nCell a\n\nCell b\n\nx y"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


_SAID = "<h1>The title here</h1><p>A first sentence of the text that goes on. Another one follows it here.</p><p>And more of it, with commas, and an end. It says something.</p>"
_KEPT = "The title here\n\nA first sentence of the text that goes on. Another one follows it here.\n\nAnd more of it, with commas, and an end. It says something."


@pytest.mark.parametrize("page, text", [
    ("<body><nav><a href=/>x</a></nav><div class='post type-post category-legal'>{}</div></body>", _KEPT),
    ("<body><form id=aspnetForm><div class=menu><a href=/a>One</a><a href=/b>Two</a></div><div>{}</div></form></body>", _KEPT),
    ("<article>{}<p class='share-price'>Price of the share 12.40</p></article>", _KEPT + "\n\nPrice of the share 12.40"),
    ("<article>{}<section class='social-history'><p>The town was founded long ago. It grew fast.</p></section></article>", _KEPT + "\n\nThe town was founded long ago. It grew fast."),
    ("<body><article>{}</article><div class=kommentare><p>Toller Text, danke. Sehr gut gemacht.</p><p>Finde ich auch. Weiter so.</p></div></body>", _KEPT),
    ("<body><div id=publicidad><p>Compre ya. Es barato.</p></div><div class=contenido>{}</div><section class=commentaires><p>Merci bien. Tr\u00e8s bon.</p></section></body>", _KEPT),
])
def test_names_alone_do_not_decide(page, text):
    assert html_text.main_text(page.format(_SAID)) == text


@pytest.mark.parametrize("page", ["<b>" * 170_000, "<div>" * 60_000 + "word " * 1000 + "</p>" * 60_000, "<a href=x>" * 50_000, "</x>" * 100_000, "<" * 100_000, "<p>one two" * 60_000])
def test_deep_and_broken_pages_take_linear_time(page):
    import time

    took = []
    for part in (page[: len(page) // 4], page):
        start = time.process_time()
        html_text.main_text(part)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.5


def test_best_region_is_the_greatest():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-2, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        low, high = html_text.best_region(scores)
        assert sum(scores[low:high]) == max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>", 1), (None, None, None, 2), (1, "u", "<article><p>a b</p></article>", 3)], "page_id long, url string, html string, text int")
    assert collected(html_text.extract(pages), "page_id", "url", "text", "n_chars") == Counter({(1, "u", "a b", 3): 2, (None, None, "", 0): 1})
    assert html_text.extract(pages.limit(0)).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------


def words(text):
    return len((text or "").encode().split())


def targets_of(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("block", [7, 1024])
def test_mix(docs, rows, none, block):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    target = targets_of(sizes)
    streams = defaultdict(list)
    for doc_id, text, source in rows:
        streams[source].append((hashlib.md5((text or "" if doc_id is None else str(doc_id)).encode()).hexdigest(), words(text), doc_id))
    want = Counter()
    for source, stream in streams.items():
        take, at = math.floor(target[source] + 0.5), 0
        for _, size, doc_id in sorted(stream, key=lambda x: x[:2]):
            whole, rest = divmod(take, sizes[source]) if sizes[source] else (0, 0)
            want[(doc_id, size, sizes[source], round(target[source], 6), whole * size + max(0, min(at + size, rest) - at))] += 1
            at += size
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs, block).collect())
    assert got == want
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs.drop("source"), block).count() == len(rows)


def test_the_schedule_is_whole_and_even(spark):
    targets = spark.createDataFrame([("=a", 1000, 2000.0), ("=b", 50, 25.0), ("=c", 5000, 3000.0), ("", 0, 0.0)], "key string, source_size long, target double")
    slots = mixing.schedule(targets, 10).toPandas()
    assert slots.slot.is_unique and slots.slot.min() >= 0
    assert slots.groupby("key").words.sum().to_dict() == {"=a": 2000, "=b": 25, "=c": 3000}
    for _, g in slots.groupby("key"):
        g = g.sort_values("slot")
        assert list(g["rank"]) == list(range(len(g)))
    order = slots.sort_values("slot").key.tolist()
    for n in (50, 100, 200, 400):
        for key, share in (("=a", 2000 / 5025), ("=c", 3000 / 5025)):
            assert abs(order[:n].count(key) - n * share) <= 8


def test_the_points_decide_what_comes_when(docs, monkeypatch):
    found = lambda: {(r.doc_id, r["size"]): (r.taken, r.slots) for r in mixing.mix(docs, 7).collect()}
    before = found()
    assert all((slots == []) == (taken == 0) and slots == sorted(slots) for taken, slots in before.values())
    monkeypatch.setattr(mixing, "reversed_bits", lambda x, bits: x)
    after = found()
    assert {k: v[0] for k, v in after.items()} == {k: v[0] for k, v in before.items()} and after != before


def test_every_stretch_of_the_mix_has_the_target_shares(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randint(5, 15)), rng.choice(["a", "a", "a", "b", "c"])) for i in range(3000)]
    out = mixing.mixed(frame(spark, rows), 16, "at").select("source", "text", "at", "doc_id").toPandas().sort_values(["at", "doc_id"])
    size = out.text.map(words)
    for part in (slice(0, 800), slice(900, 1900), slice(2500, None)):
        for source, whole in (size.groupby(out.source).sum() / size.sum()).items():
            assert abs(size[part][out.source[part] == source].sum() / size[part].sum() - whole) < 0.03


def test_equal_ids_and_sizes_are_mixed_alike_every_time(spark):
    rows = frame(spark, [(i % 4, f"{a} {b}", a) for i, (a, b) in enumerate(itertools.product("abcdefgh", "uvwxyz"))])
    runs = [collected(mixing.mixed(rows.repartition(n), 3), "doc_id", "text", "source") for n in (1, 2, 5)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 20


def test_mixed_takes_whole_copies(docs, rows, none):
    taken = [(r.doc_id, r["size"], r.taken) for r in mixing.mix(docs).collect()]
    want = Counter()
    for doc_id, size, t in taken:
        if size:
            want[(doc_id, size)] += (2 * t + size) // (2 * size)
    got = Counter((r.doc_id, words(r.text)) for r in mixing.mixed(docs).collect())
    assert got == +want
    assert mixing.mixed(none).columns == docs.columns and mixing.mixed(none).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, found", [
    ("john dot doe at example dot com now", [("email", "john dot doe at example dot com")]),
    ("x j.doe [at] mail [dot] example (dot) org y", [("email", "j.doe [at] mail [dot] example (dot) org")]),
    ("call plus one six four four five five five seven eight five nine ok", [("phone", "plus one six four four five five five seven eight five nine")]),
    ("card four one one one one one one one one one one one one one one one end", [("card", "four" + " one" * 15)]),
    ("one nine two dot one six eight dot one dot one", [("ip", "one nine two dot one six eight dot one dot one")]),
    ("аlice@еxample.com", [("email", "аlice@еxample.com")]),
    ("bob＠example．com", [("email", "bob＠example．com")]),
    ("4111​1111​1111​1111", [("card", "4111​1111​1111​1111")]),
    ("192 [.] 168 [.] 1 [.] 20", [("ip", "192 [.] 168 [.] 1 [.] 20")]),
    ("see you at the house. dot com is gone, meet at noon", []), ("one two three", []), ("a@b.co", []), ("", []),
])
def test_disguised(text, found):
    assert [(kind, text[a:b]) for kind, a, b in pii.find(text)[1]] == found


def plain_spans(t):
    import re

    digits = lambda s: sum(c in "0123456789" for c in s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= digits(m[0]) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= digits(m[0]) <= 15]


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    for alphabet in ("a1.@-+ ()2b.", "0123456789 -", "1.0259 ", "@a.-"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(40))
            assert pii.find(text)[0] == plain_spans(text), text


def test_personal_data(spark, docs, rows, none):
    extra = [(7, "mail a.b@c.de and 4111 1111 1111 1111 or +1 (644) 555-7859 at 10.0.0.1, é joe at x dot org", "s")]
    got = pii.personal_data(frame(spark, rows + extra)).collect()
    assert len(got) == len(rows) + 1
    r = next(r for r in got if r.n_email)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) == (1, 1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(pii.joined(plain_spans(extra[0][1])).encode()).hexdigest()
    assert r.spans.startswith("email:5:13,email:")
    assert pii.personal_data(none).count() == 0


@pytest.mark.parametrize("text", ["a" * 200000, "1" * 200000, " at " * 20000, "1.2." * 40000, "one " * 40000, "john dot " * 20000, "[at]" * 20000, "+1 " + " " * 50000, "a@" * 50000])
def test_long_texts_take_linear_time(text):
    pii.find(text)


# --- 5 ---------------------------------------------------------------------------------------------


def test_suffix_arrays_find_the_repeated_windows():
    rng = random.Random(3)
    for _ in range(200):
        length, alphabet = rng.choice([8, 9, 13, 16, 20]), rng.choice([b"ab", b"abc", b"a", bytes(range(256)), b"\0\xff"])
        base = bytes(rng.choice(alphabet) for _ in range(60))
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = bytearray(base[rng.randint(0, 10) : rng.randint(35, 60)])
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = rng.choice(alphabet)
            parts.append(bytes(p) + bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 6))))
        met = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        for p, got in zip(parts, suffixes.repeated_windows(parts, length)):
            assert got.tolist() == [met[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


def without_repeats(texts):
    size = suffixes.LENGTH
    met = Counter(xxhash.xxh3_128_digest(t[i : i + size]) for t in texts for i in range(len(t) - size + 1))
    for t in texts:
        marks = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - size + 1):
            if met[xxhash.xxh3_128_digest(t[i : i + size])] > 1:
                marks[i : i + size] = True
        kept = bytes(b for b, gone in zip(t, marks) if not gone)
        yield len(t), int(marks.sum()), len(suffixes.runs(marks)), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("block_bytes, piece", [(suffixes.BLOCK_BYTES, suffixes.PIECE_BYTES), (1500, 5000)])
def test_without_repeats(spark, rows, none, block_bytes, piece, monkeypatch):
    rng = random.Random(6)
    passage = prose(rng, 70)
    hot = [(500 + i, prose(rng, 25) + passage + (prose(rng, 25) if i % 3 else passage[:90]), "s") for i in range(25)]
    every = rows + hot + [(900, "ab" * 700, "s"), (901, "x" + "ab" * 700, "s"), (902, "a" * 399, "s"), (903, "a" * 400, "s")]
    want = Counter((i, *x) for (i, _, _), x in zip(every, without_repeats([(t or "").encode() for _, t, _ in every])))
    monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
    got = collected(suffixes.without_repeats(frame(spark, every).coalesce(2), block_bytes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want
    assert suffixes.without_repeats(none).count() == 0


def passages(texts):
    size, split = suffixes.PASSAGE, [(t or "").encode().split() for t in texts]
    met = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    for w in split:
        marks = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - size + 1):
            if met[tuple(w[i : i + size])] > 1:
                marks[i : i + size] = True
        yield int(marks.sum()), len(suffixes.runs(marks))


@pytest.mark.parametrize("piece", [suffixes.PIECE_BYTES, 2000])
def test_passages_of_words(spark, rows, piece, monkeypatch):
    rng = random.Random(16)
    passage = [" ".join(word(rng)[:2] for _ in range(n)) for n in (49, 50, 51, 80)]
    planted = [(600 + 10 * k + i, prose(rng, 30) + " " + p.replace(" ", rng.choice([" ", "\n"])) + " " + prose(rng, 30), "s") for k, p in enumerate(passage) for i in range(3)]
    every = rows + planted + [(700, "so it goes " * 400, "s"), (701, " ".join(map(str, range(300))), "s")]
    monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
    got = collected(suffixes.without_repeats(frame(spark, every).coalesce(2)), "doc_id", "n_passage_words", "n_passages")
    assert got == Counter((i, *x) for (i, _, _), x in zip(every, passages([t for _, t, _ in every])))
    found = {k[0] for k in got if k[1]}
    assert {610, 620, 630, 700} <= found and not {600, 601, 602, 701} & found


# --- 6 ---------------------------------------------------------------------------------------------


def test_shards(docs, rows, none):
    got = sharding.assign_shards(docs, shards=8)
    assert set(docs.columns) | {"text_crc32", "law", "shard", "grown_shard"} == set(got.columns)
    found = got.select("doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for i, t, _ in rows)
    slots = defaultdict(list)
    for r in found:
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({(r.doc_id, r.shard) for r in found}) == len({r.doc_id for r in found})
    assert sharding.assign_shards(none).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 8, 63, 64, 65, 1000])
def test_jump_moves_only_into_the_new_shard(spark, shards):
    ids = spark.range(4000).select(sharding.jump_shard(F.col("id"), shards).alias("a"), sharding.jump_shard(F.col("id"), shards + 1).alias("b")).collect()
    moved = [r for r in ids if r.a != r.b]
    assert all(r.b == shards for r in moved)
    expected = 4000 / (shards + 1)
    assert abs(len(moved) - expected) < 5 * math.sqrt(expected) + 1
    counts = Counter(r.a for r in ids)
    assert max(counts) < shards and max(counts.values()) < 4000 / shards + 6 * math.sqrt(4000 / shards) + 3


# --- 7 ---------------------------------------------------------------------------------------------


def test_language_scores(docs, rows, none):
    train, bag = [], Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    of = lambda t: [*(t or "").encode().lower().split(), b""]
    for i, t, _ in rows:
        if not held(i):
            bag.update(of(t))
    n, kinds = sum(bag.values()), len(bag)
    want = Counter()
    for i, t, _ in rows:
        base = sum(math.log10((bag[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in of(t))
        want[(i, held(i), len(of(t)), sum(bag[w] > 0 for w in of(t)), n, round(base, 6))] += 1
    for common in (language_model.COMMON, 0.01):  # 0.01: most tokens meet their counts in the join
        got = language_model.language_scores(docs, common=common).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.language_scores(none).count() == 0
    alone = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    assert {r.n_known for r in language_model.language_scores(alone).collect()} == {0}


def grown(spark, docs, common=language_model.COMMON, pairs=1e-3, gain=0.5):
    """(vocabulary as a dict, tree, spelling, the numbers of each text) of all texts of docs."""
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    vocabulary = language_model.token_counts(texts).cache()
    tree, spelling = language_model.common_tokens(vocabulary, common, gain)
    numbered = docs.select(F.lit(0).cast("long"), "doc_id", F.lit(False), F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(language_model._numbered(tree.ids), language_model._NUMBERED)
    language_model.grow(tree, numbered.filter("token is null").select("ids"), pairs, gain)
    return {bytes(r.token): r.n for r in vocabulary.collect()}, tree, spelling


def test_both_trees_are_distributions(spark, docs):
    _, tree, spelling = grown(spark, docs)
    assert len(tree.pairs) and len(tree.triples) and (tree.left1 < 1).any() and (tree.left2 < 1).any()
    for _, logs in spelling.levels:
        assert np.allclose((10.0 ** logs.astype(float)).sum(axis=1), 1, atol=1e-3)
    # After any context: the common tokens' probabilities and what is left to the others make one.
    ids = np.arange(len(tree.ids))
    rest = 1 - tree.root.sum()
    for a, b in [(0, 1), (1, 0), (2, 3), (-1, 1), (5, -1), tuple(int(x) for x in divmod(tree.pairs[0], 1 << 21))]:
        p = tree.probabilities(np.array([a, b, *(x for c in ids for x in (c, a, b))]))[::3]
        other = tree.probabilities(np.array([a, b, -1]))[0]
        assert abs(p.sum() + other * rest - 1) < 1e-6
    score = spelling.score([b"", b"th", b"zq\xff"])
    assert (score < 0).all() and np.isfinite(score).all()


@pytest.mark.parametrize("common, gain", [(language_model.COMMON, 12.0), (0.002, 1.0)])
def test_scores_are_those_of_a_plain_model(spark, none, common, gain):
    """Every row's score, rows without an id or equal in all included, from dictionaries."""
    rng = random.Random(31)
    said = prose(rng, 60)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(150)] + [prose(rng, 15) + " " + said + " " + prose(rng, 9) for _ in range(6)] + ["x y z " * 30, None]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, t, None) for t in texts[:40]] + [(3, texts[3], None), (4, texts[9], None), (902, said, None), (907, texts[20], None)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    n, tree, spelling = grown(spark, frame(spark, [r for r in rows if not held(r[0])]), common, gain=gain)
    long = language_model.LONG
    of = lambda t: [*(t or "").encode().lower().split(), b""]
    number = lambda x: np.array([tree.ids[t] for t in x], dtype=np.int64)
    chosen = lambda x: {k for k, h in enumerate(language_model.long_contexts(number(x)).tolist()) if h % language_model.THIN == 0}
    marks = Counter(tuple(of(t)[k : k + long]) for i, t, _ in rows if not held(i) for k in chosen(of(t)))
    near = lambda x: {k for k in chosen(x) if marks[tuple(x[k : k + long])] > 1}

    def parents(x):
        end = tree.ids[b""]
        p = tree.probabilities(np.r_[end, end, number(x)])
        root = lambda t: tree.root_probability(np.array([float(n.get(t, 0))]), spelling.score([t]))[0]
        return [q if t in tree.ids else q * root(t) for q, t in zip(p, x)], p

    after, parent = defaultdict(Counter), {}
    for i, t, _ in rows:
        if not held(i):
            x = of(t)
            p = parents(x)[1]
            for k in near(x):
                w = x[k + long] if x[k + long] in tree.ids else None
                after[tuple(x[k : k + long])][w] += 1
                parent[(tuple(x[k : k + long]), w)] = p[k + long]
    kept = {}
    for c, met in after.items():
        seen, kinds = sum(v for w, v in met.items() if w is not None), sum(w is not None for w in met) + 1
        whole = sum(met.values()) + kinds
        left = (whole - seen) / whole
        gained = sum(v * math.log((v / whole + left * parent[(c, w)]) / parent[(c, w)]) if w is not None else v * math.log(left) for w, v in met.items())
        if gained >= gain:
            kept[c] = (left, {w: v / whole for w, v in met.items() if w is not None})
    want = []
    for i, t, _ in rows:
        x, total = of(t), 0.0
        own = near(x)
        for k, p in enumerate(parents(x)[0]):
            left, share = kept.get(tuple(x[k - long : k]), (1.0, {})) if k - long in own else (1.0, {})
            total += math.log10(share.get(x[k], 0.0) + left * p)
        want.append((i, len(x), round(total, 5)))
    assert kept or gain > 1
    got = language_model.language_scores(frame(spark, rows).repartition(3), common, 1e-3, gain).collect()
    assert Counter((r.doc_id, r.n_tokens, round(r.score, 5)) for r in got) == Counter(want)


def test_rows_without_ids_keep_their_own_scores(spark):
    rows = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id").cast("string"), (F.col("id") % 977).cast("string")).alias("text"))
    got = language_model.language_scores(rows)
    assert got.count() == 60_000 and got.filter("n_tokens != 4 or n_known != 4 or held_out").count() == 0
    assert got.select(F.min("base_score"), F.max("base_score")).first()[0] < -8


# --- 8 ---------------------------------------------------------------------------------------------


def junk(rng, n):
    return rng.choice([lambda: " ".join(word(rng) + rng.choice(["%%%", "&&&", "###"]) for _ in range(n)), lambda: " ".join(word(rng).upper() + "!!" for _ in range(n)), lambda: (word(rng) + " ") * n])()


def test_quality(spark, none):
    rng = random.Random(9)
    good = [rng.random() < 0.75 for _ in range(1200)]
    texts = [prose(rng, rng.randint(20, 200)) if g else junk(rng, rng.randint(20, 200)) for g in good]
    every = [(i, t, None) for i, t in enumerate(texts)]
    docs = frame(spark, every)
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good) if i % 2], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert 0.6 < model.prior < 0.9
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert sum(got[i].predicted == good[i] for i in held) / len(held) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}
    # Negative labels play no part, nor does a label of a held-out row.
    flipped = labels.filter("quality = 1").unionByName(spark.createDataFrame([(i, 1, 0) for i in held], "doc_id long, quality int, toxic int"))
    assert np.allclose(quality.train(docs, flipped).weights, model.weights)
    odd = quality.score(frame(spark, awkward()), model).collect()
    assert len(odd) == len(awkward()) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(none, quality.train(none, labels.limit(0))).count() == 0
    assert {r.predicted for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {1}


# --- 9 ---------------------------------------------------------------------------------------------


def signed(x, bits):
    return (x + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


def test_fingerprints(spark, docs, rows, none):
    got = fingerprints.fingerprint_edits(docs).collect()
    order = sorted(((i if i is not None else -(10**9), signed(xxhash.xxh64_intdigest((t or "").encode(), 42), 64), t or "", i) for i, t, _ in rows), key=lambda x: x[:2])
    want = Counter()
    for k, (_, _, text, doc_id) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        want[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = defaultdict(set)
    ids = {(i, len(t or "")): t for i, t, _ in rows}
    for r in got:
        by_text[ids[(r.doc_id, r.n_chars)]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    long = [r for r in got if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.5
    assert fingerprints.fingerprint_edits(none).count() == 0
    for n in (1, 2):
        assert fingerprints.fingerprint_edits(frame(spark, rows[3 : 3 + n]), rows=1).count() == n


@pytest.mark.parametrize("cuts", [1, 5, 64])
def test_next_texts_cross_the_ranges(spark, cuts):
    rng = random.Random(2)
    ids = sorted(rng.sample(range(-(10**6), 10**9), 300)) + [2**62]  # one far from all others
    rows = [(i, f"t{i}") for i in ids] + [(77, f"same{k}") for k in range(200)] + [(None, f"none{k}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42), 64)))
    want = Counter((*a, b[1], len(b[1])) for a, b in zip(order, order[1:] + order[:1]))
    got = fingerprints.with_next(docs, {"n": F.length("text")}, rows=7, cuts=cuts)
    assert collected(got.select("doc_id", "text", F.col("next.text").alias("t"), F.col("next.n").alias("n")), "doc_id", "text", "t", "n") == want
    ranged = fingerprints.with_ranges(docs.withColumn("th", F.xxhash64("text")), rows=7, cuts=cuts)
    assert ranged.groupBy("part", "slice").count().agg(F.max("count")).first()[0] <= max(40, len(rows) // cuts)


def plain_vector(text):
    """The lanes by hand."""
    import re

    signed64 = lambda t, seed=42: xxhash.xxh64_intdigest(t.encode(), seed)
    equal = [0] * 4
    for p in (text or "").split("\n"):
        if p:
            a, b = signed64(p), xxhash.xxh64_intdigest((1).to_bytes(4, "little"), signed64(p))
            for k, x in enumerate((a & 0xFFFFFFFF, a >> 32)):
                equal[k] = (equal[k] + x) % (1 << 32)
    pieces = [x.rstrip(" ") for x in re.findall(r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,4}", text or "")]
    like = [0] * 64
    for p in pieces:
        h = signed64(p)
        for k in range(16):
            for j in range(4):
                like[4 * k + j] += 1 if h >> (k + 16 * j) & 1 else -1
    return equal[:2], like


def test_vectors_are_those_of_a_plain_version(spark):
    texts = [t for _, t, _ in awkward(11)] + ["word " * 300_000]
    got = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "i int, text string").select("i", fingerprints.fingerprint_vector(F.col("text")).alias("v")).collect()
    for r in got:
        equal, like = plain_vector(texts[r.i])
        assert r.v[:2] == equal and r.v[4:] == like


def test_fingerprints_add_up_and_ignore_order(spark):
    a, b = "One two three four five six.\nSeven eight", "Nine\nten ten ten"
    df = spark.createDataFrame([(a, b, a + "\n" + b, b + "\n" + a, "Seven eight\nten ten ten\nNine\nOne two three four five six.")], "a string, b string, ab string, ba string, mixed string")
    v = fingerprints.fingerprint_vector
    r = df.select(fingerprints.combine(v(F.col("a")), v(F.col("b"))).alias("sum"), v(F.col("ab")).alias("ab"), v(F.col("ba")).alias("ba"), v(F.col("mixed")).alias("mixed"),
                  fingerprints.combine(v(F.col("ab")), v(F.col("b")), -1).alias("less"), v(F.col("a")).alias("a")).first()
    assert r["sum"] == r.ab == r.ba == r.mixed and r.less == r.a != r.ab


# --- 10 --------------------------------------------------------------------------------------------


def simhash_of(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(s))


def classes(values, bits=2):
    """The lowest position that each reaches."""
    f = np.array(values, dtype=np.uint64)
    root = list(range(len(f)))
    for i in range(len(f)):
        for j in np.nonzero(np.bitwise_count(f[i] ^ f) <= bits)[0]:
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if x == max(a, b) else x for x in root]
    return root


def test_near_duplicates(docs, rows, none):
    f = [simhash_of(t or "") for _, t, _ in rows]
    root = classes(f)
    ids = [i for i, _, _ in rows]
    lowest = {r: min((i for i, x in zip(ids, root) if x == r and i is not None), default=None) for r in root}
    want = Counter((i, f"{x:016x}", lowest[r]) for i, x, r in zip(ids, f, root))
    assert collected(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len(set(root)) and {r.doc_id for r in kept} == set(lowest.values())
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).columns == none.columns


@pytest.mark.parametrize("cell_rows, blocks", [(simhash.CELL, None), (8, None), (8, 5)])
def test_links_connect_what_is_within_two_bits(spark, cell_rows, blocks):
    rng = random.Random(11)
    values = {rng.getrandbits(64) for _ in range(60)}
    seed = rng.getrandbits(64)
    for _ in range(150):
        values.add(seed)
        for b in rng.sample(range(64), rng.randint(1, 3)):
            seed ^= 1 << b
    values |= {0, 1, (1 << 64) - 1, 1 << 63, (1 << 63) + 1}
    values = sorted(signed(v, 64) for v in values)
    root = classes([v % (1 << 64) for v in values])
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), cell_rows=cell_rows, blocks=blocks)
    stars = {r.node: r.root for r in components(links).collect()}
    assert {v: stars.get(v, v) for v in values} == {v: values[r] for v, r in zip(values, root)}


def test_blocks_tell_the_fingerprints_apart():
    assert [simhash.blocks_for(n, 2) for n in (0, 1000, 1 << 21, 1 << 22, 10**11)] == [3, 3, 3, 4, 5]


def test_rows_equal_in_id_and_text_leave_one_by_their_columns(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", s) for s in ("x", "y", "z")] * 3, "doc_id long, text string, source string")
    assert len({r.source for n in (1, 3, 5) for r in simhash.one_of_similar(rows.repartition(n)).collect()}) == 1


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components(path).collect()} == {0}
    assert components(path.limit(0)).count() == 0
