"""Every registered query of the operators: its contracted columns against plain readings, on a folder of odd rows and on an empty one; SQL against DuckDB."""

import hashlib
import json
import math
import os
import random
import re
import zlib

import duckdb
import pytest

from assay.llm import language, registry, secrets
from tests.llm.test_operators import brute_groups

DATA = "/root/testdata/sf0.001"
FORM = "doc_id long, text string, lang string, source string, n_chars int, id long, `row` string, n long, key long, node long, mark string, size long, label string"


def some_documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.choice([4, 6, 9, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(90):
        w = base[i % 12][:]
        for _ in range(rng.randint(0, max(1, len(w) // 15))):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w), ("en", "de", None)[i % 3] if i % 7 else None, ("web", "code", "books", None, "a", "Z")[i % 6]))
    odd = [None, "", " \n\t\x0b", "one", "A B c", "a b C", "1 2 3", "Été à l'œuvre ＡＢ", "漢字 かな", "long words here " * 4000]
    odd += ["Password: hunter22 and token=abc AKIA" + "Z9" * 9 + " " + "0a1b" * 8, "under the MIT license. Apache License, Version 2; cc-by-nc under the mit license", "secret:  \"x+/=_.-z\" api_key = 'k' ApiKey=123456", "<|endoftext|> a 'b' don't  x", "q7Gz81KpLx03VbTn55Rw"]
    rows += [(200 + k, t, "en" if k % 2 else None, None) for k, t in enumerate(odd)]
    rows += [(None, "null id text here", "en", "web"), (None, None, None, None), (5, rows[5][1], "en", "web"), (7, "another text with the id seven", "de", "code"), (300, rows[3][1], "en", "x"), (300, rows[3][1], "en", "x"), (-4, rows[4][1], "en", "x")]
    return [(i, t, l, s, len(t or ""), 9, "r", 1, 2, 3, "m", 4, "b") for i, t, l, s in rows]


LONGEST = sorted((d[1] for d in some_documents()[:12]), key=len)[-2:]
PAGES = [None, "", "http://a.net/x", "HTTP://B.Example.NET/en/y?z#q", "ftp://example.net/EN/", "https://sub.example.com/de/", "https://example.comx/de/", "http://x.org/fr/a/../b", "http://x.org/fr", "no scheme/casino", "a://", "a://casino.com/", "http://ok.com/mycasino/casino-x", "http://ok.com/free/win", "http://ok.com/freewin", "http://ok.com/free?free#FREE", "x://y://net/", "http://user@net:80/", "http://net", "http://net/", "http://ß.net/", "http://ok.com/" + "a" * 30000 + "/xxx"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    docs = some_documents()
    spark.createDataFrame(docs, FORM).repartition(3).write.parquet(f"{top}/documents.parquet")
    pages = [(k if k != 3 else None, u, "<p>", 1, "x", "y") for k, u in enumerate(PAGES)] + [(4, PAGES[4], "<p>", 1, "x", "y")]
    spark.createDataFrame(pages, "page_id long, url string, html string, id long, host string, rule string").write.parquet(f"{top}/pages.parquet")
    spark.createDataFrame([(1, LONGEST[0], "x"), (None, LONGEST[1] + " tail", "x"), (2, None, "x"), (3, "nothing like it at all in here", "x")], "item_id long, text string, leaks string").write.parquet(f"{top}/benchmark.parquet")
    return top, docs, pages


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory, folder):
    top = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(f"{top}/{t}.parquet")
    return top


def rows_of(spark, name, top, *columns):
    return sorted((tuple(r) for r in registry.QUERIES[name](spark, top).select(*columns).collect()), key=str)


def same(got, want):
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert registry.QUERIES[name](spark, nothing).count() == 0


def test_op1(spark, folder):
    want = []
    for i, t, *_ in folder[1]:
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    same(rows_of(spark, "op1_media_columns", folder[0], "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"), want)
    kept = registry.QUERIES["op1_media_columns"](spark, folder[0]).select("payload_sha256", "media_bytes", "media_sha256", "feature").distinct().collect()
    assert len({r.payload_sha256 for r in kept}) == len(kept) and all(len(r.media_sha256) == 64 and r.media_bytes > 0 and re.fullmatch("[0-9a-f]{16}", r.feature) for r in kept)


def test_op2(spark, folder):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    encode, want = secrets.vocabulary(None).encode_ordinary, []
    for i, t, *_ in folder[1]:
        t = t or ""
        base = [("assign", *m.span()) for m in assign.finditer(t) if len(m[1]) >= 6] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        # The method's spans, tried one by one.
        more = []
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", t):
            random_like = len(m[0]) <= 2 * len(encode(m[0])) and not secrets.known(m[0], encode, 2.0)
            if random_like and not any(set(range(*m.span())) & set(range(a, b)) for _, a, b in base):
                more.append(("token", *m.span()))
        every = sorted(base + more, key=lambda s: (s[1], ("assign", "access", "hex", "token").index(s[0])))
        want.append((i, *(sum(k == x for k, *_ in base) for x in ("assign", "access", "hex")), hashlib.sha256(said(base).encode()).hexdigest(), said(every)))
    got = rows_of(spark, "op2_secret_scan", folder[0], "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    same(got, want)
    assert any("token:" in r[5] for r in got) and any(r[1] for r in got) and any(r[2] for r in got) and any(r[3] for r in got)


def test_op3(spark, folder):
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op3_decontamination"](spark, folder[0]).collect()}
    items = [(1, LONGEST[0]), (None, LONGEST[1] + " tail")]
    want = set()
    for i, t, *_ in folder[1]:
        words = (t or "").split()
        for k, item in items:
            own = item.split()
            grams = lambda w: [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))]
            held = [set(grams(x.split())) for _, x in items]
            weight = lambda g, held=held: 1 / max(1, sum(g in h for h in held))
            for a in range(max(1, len(words) - len(own) + 1)) if words else ():
                x, y = grams(words[a : a + len(own)]), grams(own)
                every = set(x) | set(y)
                low, high = (sum(weight(g) * f(x.count(g), y.count(g)) for g in every) for f in (min, max))
                if low / high >= 0.8:
                    want.add((i, k))
                    break
    assert got == want and len(want) >= 3


def test_op4(spark, folder):
    got = registry.QUERIES["op4_language_id"](spark, folder[0]).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    learned = {l for i, t, l, *_ in folder[1] if l and not held(i)}
    assert sorted(((r.doc_id, r.held_out) for r in got), key=str) == sorted(((i, held(i)) for i, *_ in folder[1]), key=str)
    assert all(r.lang_pred in learned | {"und"} and 0 <= r.score <= 1 for r in got)
    blank = sorted((i for i, t, *_ in folder[1] if not any(c.isalpha() for c in t or "")), key=str)
    assert sorted((r.doc_id for r in got if r.lang_pred == "und"), key=str) == blank


def test_op4_on_held_out_documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    own = [r for r in registry.QUERIES["op4_language_id"](spark, DATA).collect() if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert own and sum(r.lang_pred == truth[r.doc_id] for r in own) >= 0.95 * len(own)


def test_op5(spark, folder):
    got = registry.QUERIES["op5_pseudo_likelihood"](spark, folder[0]).collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.n_words) for r in got), key=str) == sorted(((i, n(t)) for i, t, *_ in folder[1]), key=str)
    assert all((r.log_prob < 0) == (r.n_words > 0) and (r.mean_log_prob is None) == (r.n_words == 0) and 0 <= r.n_unknown <= r.n_words for r in got)
    counts = {}
    for _, t, *_ in folder[1]:
        for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            counts[w] = counts.get(w, 0) + 1
    unknown = lambda t: sum(counts[w] == 1 for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    assert sorted(((r.doc_id, r.n_unknown) for r in got), key=str) == sorted(((i, unknown(t)) for i, t, *_ in folder[1]), key=str)
    barely = lambda t: sum(counts[w] == 2 for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    rare = [(i, barely(t), round(barely(t) / max(1, barely(t) + unknown(t)), 9)) for i, t, *_ in folder[1]]
    assert sorted(((r.doc_id, r.n_barely, round(r.rare_known, 9)) for r in got), key=str) == sorted(rare, key=str)
    again = registry.QUERIES["op5_pseudo_likelihood"](spark, folder[0]).collect()
    assert sorted(((r.doc_id, round(r.log_prob, 3)) for r in again), key=str) == sorted(((r.doc_id, round(r.log_prob, 3)) for r in got), key=str)


def test_op6(spark, folder):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    want = []
    for i, t, *_ in folder[1]:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        places = [(a, label) for label, p in phrases.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        want.append((i, len(w), len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
    same(rows_of(spark, "op6_license_scan", folder[0], "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), want)
    for r in registry.QUERIES["op6_license_scan"](spark, folder[0]).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_op7(spark, folder):
    got = rows_of(spark, "op7_near_duplicates", folder[0], "doc_id", "n_shingles", "component_id")
    assert got == brute_groups([(i, t) for i, t, *_ in folder[1]], 2)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) or r.doc_id is None for r in registry.QUERIES["op7_near_duplicates"](spark, folder[0]).collect())


def test_short_pairs_at_the_threshold_are_linked(spark, tmp_path):
    """Sets of 4 and 5 shingles, similarity exactly 0.8, which a sketch alone tells badly; all are links."""
    rng, rows = random.Random(9), []
    for k in range(400):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(6)]
        rows += [(2 * k, " ".join(w), "en", "s", 1), (2 * k + 1, " ".join(w[:-1]), "en", "s", 1)]
    rows += [(9000, "w912594 w372561 w899673 w892667 w819741 w528065", "en", "s", 1), (9001, "w912594 w372561 w899673 w892667 w819741", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.component_id for r in registry.QUERIES["op7_near_duplicates"](spark, str(tmp_path)).collect()}
    lost = [k for k, c in got.items() if c != k - k % 2]
    assert not lost


def test_near_duplicates_without_ids(spark, tmp_path):
    """Texts are found again by their hash, so rows without an id do not meet one another."""
    rows = [(None, " ".join(f"g{g}w{j}" for j in range(30)) + (" tail" if k else ""), "en", "s", 1) for g in range(40) for k in range(3)] + [(7, "g0w0", "en", "s", 1), (7, " ".join(f"g3w{j}" for j in range(30)), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(spark, "op7_near_duplicates", str(tmp_path), "doc_id", "n_shingles", "component_id")
    assert got == brute_groups([(i, t) for i, t, *_ in rows], 2)


def test_op8(spark, folder):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = registry.QUERIES["op8_token_files"](spark, folder[0]).collect()
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in folder[1]]
    said = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((i, len(x), said(x)) for i, x in ids), key=str)
    order = sorted(got, key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in order]
    assert keys == sorted(keys) and [r.start for r in order] == [sum(x.n_tokens for x in order[:k]) for k in range(len(order))]


def test_op9(spark, folder):
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    want, told = [], {}
    for i, u, *_ in folder[2]:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = low(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0] if rest else ""
        fits = [k for k in rules if (host == k[0] or host.endswith("." + k[0])) and path.startswith(k[1])]
        best = max(fits, key=lambda k: len(k[0] + k[1]), default=None)
        want.append((i, host, path, best and best[0] + best[1]))
        told[(i, u)] = best and rules[best]
    same(rows_of(spark, "op9_url_filter", folder[0], "page_id", "host", "path", "rule"), want)
    verdicts = {r.page_id: r.verdict for r in registry.QUERIES["op9_url_filter"](spark, folder[0]).collect()}
    assert all(v is None or verdicts[i] == v for (i, _), v in told.items())
    at = {u: verdicts[k] for k, u in enumerate(PAGES) if k != 3}
    assert at[None] == at[""] == at["http://ok.com/freewin"] == at["http://ok.com/free?free#FREE"] == "allow" and at["a://casino.com/"] == at["http://ok.com/mycasino/casino-x"] == at["http://ok.com/free/win"] == at[PAGES[-1]] == "block"


def test_op10(spark, folder):
    got = registry.QUERIES["op10_source_mixing"](spark, folder[0]).collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = {}
    for _, t, _, s, *_ in folder[1]:
        size[s] = size.get(s, 0) + n(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s in share if share[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    target = {**share, **{s: 3 * size[s] for s in capped}}
    sources = {(i, n(t)): s for i, t, _, s, *_ in folder[1]}
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((i, n(t)) for i, t, *_ in folder[1]), key=str)
    assert sorted((r.source_size, round(r.target, 6)) for r in got) == sorted((size[s], round(target[s], 6)) for _, _, _, s, *_ in folder[1])
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and sources[(r.doc_id, r.size)] in size
        taken[round(r.target, 6)] = taken.get(round(r.target, 6), 0) + r.taken
    want = {}
    for s in order:
        want[round(target[s], 6)] = want.get(round(target[s], 6), 0) + target[s]
    assert all(abs(taken[k] - want[k]) <= len(order) for k in want)
    again = registry.QUERIES["op10_source_mixing"](spark, folder[0]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    tidy = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    table = lambda cols, rows: (sorted(cols), sorted((json.dumps([tidy(r[cols.index(c)]) for c in sorted(cols)]) for r in rows)))
    got = registry.QUERIES[name](spark, DATA)
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(names, want.fetchall())


def test_language_bounds_are_stated():
    assert language.CELLS == 1 << 26 and language.BITS == 16
