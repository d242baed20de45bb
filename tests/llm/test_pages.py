"""Operators over pages and conversations."""

import math
import random
import re
import time

from hearthlog.llm import chat, extraction, language, warc

from .helpers import sha

PAGES = "page_id long, url string, html string, text string, archive string"


def test_extraction(spark):
    page = (
        "<html><head><title>x</title></head><body><div id=header>Site<a href=/>home</a></div><div class=wrap><div class='content no-sidebar'><h1>Head &amp; line</h1><p>First para with long   text\n here and more words to read."
        "<p>Second paragraph, with a <a href=x>link</a>&nbsp;and text, enough of it.<ul><li>One item<li>Two item</ul></div><div class=sidebar>side <a>l</a></div><div class=comments><p>A reader says long text that goes on, with very many words here, longer than the article, on and on.</p></div></div>"
        "<div class=cookie-notice>We use cookies</div><form>Name <input></form><footer>End</footer><script>var t='</p>';</script></body></html>"
    )
    want = "Head & line\n\nFirst para with long text here and more words to read.\n\nSecond paragraph, with a link and text, enough of it.\n\nOne item\n\nTwo item"
    rows = [(1, "u", page, "t", "a"), (2, None, None, None, None), (3, "u", "", "t", "a"), (4, "u", "no tags &lt;b", "t", "a"), (5, "u", "<div>" * 5000 + "deep", "t", "a"), (5, "u", '<p title="open>abc</p> def', "t", "a"), (6, "u", "<article><h1>T</h1><p>short</article><p>outside", "t", "a")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extraction.extract(spark.createDataFrame(rows, PAGES)).collect())
    texts = sorted([(1, want), (2, ""), (3, ""), (4, "no tags <b"), (5, "deep"), (5, "abc\n\ndef"), (6, "T\n\nshort\n\noutside")])
    assert got == [(i, t, len(t)) for i, t in texts]
    assert extraction.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_classes_that_are_subjects_stay():
    p = "<p>" + "The story goes on with many plain words of a long sentence. " * 6 + "</p>"
    inside = "<p>Inside " + "words of the story " * 9 + "</p>"
    page = lambda c: f"<html><body><div>{p}<div class='{c}'>{inside}</div>{p}</div></body></html>"
    for c in "share-price related-work ad-free menu-of-the-day comment-on-law notice-period promotion-history toc-title skip-list reply-brief sharing signup-rules".split():
        assert "Inside" in extraction.main_text(page(c)), c
    for c in "share-buttons related-posts ad-slot site-nav cookie-banner comment-list comments sidebar-left newsletter-signup skip-link".split():
        assert "Inside" not in extraction.main_text(page(c)) and "The story" in extraction.main_text(page(c)), c
    for h in (f"<article class='post comments-open'>{p}{p}</article>", f"<div class='post ad-free'>{p}{p}</div>"):
        assert len(extraction.main_text(f"<html><body>{h}</body></html>")) > 700


def test_broken_pages_take_linear_time():
    shapes = {"q": "<div>" * 40_000 + "</q>" * 200_000, "a": "<a " * 350_000, "b": "<b><div>" + "<span>" * 80_000 + "</b>" * 80_000, "comment": "<!--" * 250_000, "script": "<script>" * 130_000, "lt": "<" * 1_000_000, "nav": "<nav>" + "<div>" * 60_000 + "</q>" * 100_000, "title": "<title>" * 140_000, "p": "<p>x" * 200_000}
    for name, h in shapes.items():
        began = time.time()
        extraction.main_text(h)
        language.visible(h)
        assert time.time() - began < 15, name
    assert language.visible("a<b>c<!-- d --><script>x</SCRIPT >e &amp; <title>f</title><!-- g > h <i") == "a c  e &    h <i"


def test_archive_of_many_records():
    """Time grows with the records, not with their square; frames, skippable frames and damage are told apart."""
    import zstandard

    pack = zstandard.ZstdCompressor()
    r = random.Random(3)
    records = [bytes(r.choices(range(256), k=r.randint(0, 9000))) for _ in range(8000)]
    content = b"".join(pack.compress(x) + (b"\x50\x2a\x4d\x18\x03\0\0\0abc" if k % 9 == 0 else b"") for k, x in enumerate(records))
    began = time.time()
    assert [d for d, e in warc.frames(content) if not e] == records
    assert time.time() - began < 5
    assert [e for _, e in warc.frames(content[:-20])][-1].endswith("is cut off")
    assert "frame at" in [e for _, e in warc.frames(content + b"damage")][-1]


def test_extraction_keeps_all_articles():
    say = lambda k, n: f"{k} " + "some words of the story go on here and " * n + "end."
    for parts in (3, 1):  # paragraphs an article
        page = "<body><div>" + "".join("<article>" + f"<p>{say(k, 4)}</p>" * parts + "</article>" for k in ("one", "two", "three")) + "</div></body>"
        assert [extraction.main_text(page).count(k) for k in ("one", "two", "three")] == [parts] * 3
    beside = f"<body><article><p>{say('one', 5)}</p><p>{say('two', 5)}</p></article><article><a href=x>{say('links', 5)}</a></article></body>"
    assert "two" in extraction.main_text(beside) and "links" not in extraction.main_text(beside)


def test_extraction_by_density_alone(spark):
    """Element names decide nothing: pages whose article elements are plain blocks give the same texts."""
    pages = [r["html"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    for html in pages:
        plain = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", html)
        assert extraction.main_text(html) == extraction.main_text(plain)
    story = " ".join(f"<p>{k} some words of a story, with <b>bold</b> ones and an end.</p>" for k in range(30))
    for box in ("div", "section", "article"):
        html = f"<body><div><ul>{'<li><a href=x>menu entry</a></li>' * 20}</ul></div><div><{box}><h2>Head</h2>{story}</{box}><p>Short.</p><{box}>{story}</{box}></div></body>"
        text = extraction.main_text(html)
        assert text.count("story") == 60 and "Head" in text and "Short." in text and "menu" not in text
    long = f"<body><div>{story * 400}</div></body>"  # about a megabyte
    assert extraction.main_text(long).count("story") == 12000


def test_density_sums_by_brute_force(spark):
    """The core is the node whose children's densities have the largest sum, computed node by node from its text."""
    for html in [r["html"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]:
        root = extraction.parse(html)

        def walk(n):
            yield n
            for x in n.parts:
                if isinstance(x, extraction.Node):
                    yield from walk(x)

        size = lambda n, link=False: sum((0 if isinstance(x, extraction.Node) else len("".join(x.split()))) if not isinstance(x, extraction.Node) else size(x) for x in n.parts)
        tags = lambda n: [x for x in walk(n) if x is not n and x.name not in extraction.INLINE]
        links = lambda n: [x for x in walk(n) if x.name == "a" and not any(y is not x and y.name == "a" and x in list(walk(y)) for y in walk(n))]
        whole = size(root)
        share = sum(map(size, links(root))) / whole if whole else 0

        def density(n):
            c, t = size(n), max(1, len(tags(n)))
            lc, lt = sum(map(size, links(n))), max(1, sum(len(tags(x)) for x in links(n)) + sum(x is not n for x in links(n)))
            return c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1) / math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e) + 1) if c else 0.0

        want = {id(n): sum(density(x) for x in n.parts if isinstance(x, extraction.Node) and x.name not in extraction.INLINE) for n in walk(root)}
        extraction.measure(root)
        assert all(abs(n.total - want[id(n)]) <= 1e-6 * (1 + n.total) for n in walk(root))
        if whole:
            assert want[id(extraction.cores(root)[0])] >= max(want.values()) - 1e-6 * (1 + max(want.values()))


def test_warc_round_trip(spark):
    big = "x" * 150
    rows = [(-9, "u\r\nb é", big), (-5, None, big), (-7, "u", None), (-8, "u", ""), (-3, "u", "é" * 60), (-2, "u", "é" * 60), (-1, "q", "short"), (-4, "q", "short"), (10, "u", "long " * 200000)]
    df = spark.createDataFrame([(*r, "t", "a") for r in rows], PAGES)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["error"]) for r in warc.round_trip(df).collect()}
    least: dict = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100:
            least[h] = min(least.get(h, i), i)
    assert got == {i: (len((h or "").encode()), sha(h or ""), "response" if least.get(h, i) == i else "revisit", None if least.get(h, i) == i else least[h], "") for i, _, h in rows}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_ids(spark, tmp_path):
    """One id with two payloads, repeated rows, null ids; and archives as files read by Spark."""
    a, b = "a" * 150, "b" * 150
    rows = [(1, a), (5, a), (5, b), (7, b), (9, b), (9, b), (None, a), (None, "n" * 200), (None, "n" * 200)]
    df = spark.createDataFrame([(i, "u", h, "t", "a") for i, h in rows], PAGES)
    got = sorted(repr((r["page_id"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"], r["error"])) for r in warc.round_trip(df).collect())
    want = [(1, a, None), (5, a, 1), (5, b, None), (7, b, 5), (9, b, 5), (9, b, 5), (None, a, 1), (None, "n" * 200, None), (None, "n" * 200, None)]
    assert got == sorted(repr((i, sha(h), len(h), "response" if r is None else "revisit", r, "")) for i, h, r in want)
    for k, r in enumerate(warc.write_archives(df).collect()):
        (tmp_path / f"{k}.warc.zst").write_bytes(r["content"])
    read = warc.read_archives(spark.read.format("binaryFile").load(f"file://{tmp_path}"))
    assert sorted((repr(r["page_id"]), (r["payload"] or b"").decode()) for r in read.collect()) == sorted((repr(i), "" if r else h) for i, h, r in want)


def test_warc_reports_damage():
    records = [warc.record(i, "u", b"hello" * i, sha(b"hello" * i), None) for i in range(50)]
    whole = warc.archive(records)
    assert [d for d, _ in warc.frames(whole)] == records and not any(warc.parse(r)["error"] for r in records)
    assert [e for _, e in warc.frames(whole[:-5])][-1].endswith("cut off") and list(warc.frames(b"")) == []
    assert list(warc.frames(whole[:20])) == [(None, "dictionary is cut off")]
    r = records[9]
    assert warc.parse(b"x")["error"] and "found" in warc.parse(r[:-6] + r[-4:])["error"] and "digest" in warc.parse(r.replace(b"hellohello", b"hellohullo"))["error"]
    assert "without" in warc.parse(r.replace(b"WARC-Date", b"WARC-Time"))["error"]


def test_language(spark):
    r = random.Random(4)
    vocab = {"en": ["the", "house", "and", "with", "weather"], "fr": ["maison", "avec", "les", "été", "jour"]}
    say = lambda k, n: " ".join(r.choices(vocab[k], k=n))
    labelled = spark.createDataFrame([(say(k, 60), k) for k in vocab for _ in range(40)] + [(None, "en"), ("x", None)], "text string, lang string")
    pages = spark.createDataFrame([(i, f"http://a.example.{'fr' if i % 2 else 'com'}/p", f"<html lang={'fr' if i % 2 else 'en'}><p>{say('fr' if i % 2 else 'en', 40)}</p>", None, None) for i in range(60)] + [(97, "http://a.example.fr/q", None, None, None), (98, None, "", None, None), (99, "http://b.org/", f"<html lang=en><p>{say('fr', 50)}</p>", None, None)], PAGES)
    got = {x["page_id"]: x for x in language.identify(pages, labelled).collect()}
    assert len(got) == 63 and all(got[i]["lang"] == ("fr" if i % 2 else "en") for i in range(60))
    assert got[97]["lang"] == "fr" and got[97]["text_lang"] is None and got[99]["lang"] == "fr" and got[98]["host"] == ""
    assert language.identify(pages.limit(0), labelled).count() == 0 and language.identify(pages, labelled.limit(0)).count() == 0


def test_language_held_out(spark):
    import numpy as np
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = language.train(docs.filter("doc_id % 2 = 0"))
    rows = docs.filter("doc_id % 2 = 1").collect()
    found = language.likelihoods(pa.array([x["text"] for x in rows], pa.large_string()), table).argmax(axis=1)
    assert np.mean([langs[i] == x["lang"] for i, x in zip(found, rows)]) > 0.97


def test_language_fusion_by_brute_force(spark):
    """Priors, evidence and posterior of every page of the driver's table, page by page, from the text likelihoods."""
    from collections import defaultdict

    import numpy as np
    import pyarrow as pa

    pages, docs = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("pages", "documents"))
    langs, table = language.train(docs.select("text", "lang"))
    table = table.astype(np.float32)
    rows, n = pages.collect(), len(langs)
    text = language.likelihoods(pa.array([language.visible(r["html"] or "") for r in rows], pa.large_string()), table)
    p = np.exp(text - text.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    host = [(re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", r["url"] or "") or [None, ""])[1].lower() for r in rows]
    domain = [language.registered(h) for h in host]
    said = [m[1].lower() if (m := re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", r["html"] or "")) else None for r in rows]
    path = [m[1].lower() if (m := re.match(r"[^/]*//[^/]*/([A-Za-z]{2})(?:[/?#]|$)", r["url"] or "")) else None for r in rows]
    world = (p.sum(axis=0) + 1) / (len(rows) + n)

    def shares(keys, wider):
        total = defaultdict(lambda: np.zeros(n))
        for k, x in zip(keys, p):
            total[k] += x
        return {k: (v + language.PRIOR * wider(k)) / (v.sum() + language.PRIOR) for k, v in total.items()}

    domains = shares(domain, lambda k: world)
    hosts = shares(host, lambda k: domains[language.registered(k)])

    def evidence(values):
        total = defaultdict(lambda: np.zeros(n))
        for v, x in zip(values, p):
            if v is not None:
                total[v] += x
        t = sum(total.values())
        return {v: np.log((x + language.PRIOR * x.sum() / t.sum() + 1e-6) / (t + language.PRIOR)) for v, x in total.items()}

    known = lambda xs: [x if x in langs else None for x in xs]
    kinds = [known(said), known(path), [h.rsplit(".", 1)[-1] for h in host]]
    tables = [evidence(k) for k in kinds]
    got = {r["page_id"]: r for r in language.identify(pages, docs.select("text", "lang")).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        post = text[k] + np.log(hosts[host[k]]) + sum(t[v[k]] for t, v in zip(tables, kinds) if v[k] is not None)
        x = got[r["page_id"]]
        assert x["lang"] == langs[int(post.argmax())] and abs(x["confidence"] - 1 / np.exp(post - post.max()).sum()) < 1e-4


def test_language_sample_ignores_copies(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    rows = [(f"alpha{i} beta", "en") for i in range(40)] * 50 + [(f"maison{i} jour", "fr") for i in range(15)] + [(None, "fr")] * 3000
    found = language.sample(spark.createDataFrame(rows, "text string, lang string")).collect()
    assert len(set(found)) == len(found) and sum(x["lang"] == "en" for x in found) == 20 and sum(x["lang"] == "fr" for x in found) == 15
    once, copied = (language.train(spark.createDataFrame(x, "text string, lang string"))[1] for x in (sorted(set(rows[:2015])), rows))
    assert (once == copied).all()


def test_language_of_many_languages_and_long_starts(spark):
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopq"]
    say = lambda k, n: " ".join([f"{k}{k}{k[::-1]}"] * n)
    rows = [(say(k, 20 + i), k) for k in names for i in range(3)] + [("0 " * 3000 + say("zz", 50), "zz")]  # a long start that tells nothing
    pages = [(i, f"http://h{i}.example/", f"<html lang={k}><p>{say(k, 30)}</p>", None, None) for i, k in enumerate([*names, "zz"])]
    got = {x["page_id"]: (x["lang"], x["text_lang"], x["declared"]) for x in language.identify(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert got == {i: (k, k, k) for i, k in enumerate([*names, "zz"])}


CONV = "conv_id long, turn long, role string, text string, node long"


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>user\nx", "&a; & &l;|", "ends with <", "|im_start|>", "", None, "a\nb", "é" * 100]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x, 0) for c in (1, 2) for t, x in enumerate(odd)] + [(3, 0, None, "q", 0), (3, 0, "assi\nstant", "r", 0), (None, None, "assistant", "z", 0), (4, 1, "user", "t", 0), (4, 1, "user", "t", 0)]
    got = {r["conv_id"]: r for r in chat.digest(chat.format_trees(chat.from_turns(spark.createDataFrame(rows, CONV)))).collect()}
    by: dict = {}
    for c, t, role, x, _ in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", x or ""))
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    assert len(got) == len(by) and chat.digest(chat.format_trees(chat.from_turns(spark.createDataFrame([], CONV)))).count() == 0


def test_reply_trees(spark):
    #      1 -> 2 -> 4 (best), 1 -> 3, 9 without its parent, 20 <-> 21 in a circle
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 0.5), (1, 4, 2, "user", "c", None), (1, 9, 8, "user", "lost", 0.0), (2, 20, 21, "user", "x", 1.0), (2, 21, 20, "user", "y", 1.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    assert sorted((r["leaf"], r["rank"], r["path"]) for r in chat.paths(nodes, None).collect()) == [(3, 2, [1, 3]), (4, 1, [1, 2, 4]), (9, 3, [9])]
    (one,) = chat.read_back(chat.format_trees(nodes)).collect()
    assert [tuple(t) for t in one["turns"]] == [("user", "q"), ("assistant", "a"), ("user", "c")] and one["loss_texts"] == ["a"]
    doubled = chat.format_trees(nodes.unionByName(nodes)).collect()
    assert [(r["tree"], r["formatted"]) for r in doubled] == [(r["tree"], r["formatted"]) for r in chat.format_trees(nodes).collect()]


def test_branching_trees_by_brute_force(spark):
    """All root-to-leaf paths of random trees, ranked; and a conversation of 10,000 turns."""
    r, rows = random.Random(6), []
    for tree in range(20):
        rows += [(tree, k, None if k == 0 or r.random() < 0.05 else r.randrange(k), r.choice(["user", "assistant"]), f"t{k}", r.choice([None, 0.5, 1.0, 2.0])) for k in range(r.randint(1, 60))]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    want = []
    for tree in range(20):
        own = {k: (p, s or 0.0) for t, k, p, _, _, s in rows if t == tree}
        found = []
        for leaf in set(own) - {p for p, _ in own.values()}:
            path = [leaf]
            while own[path[-1]][0] is not None:
                path.append(own[path[-1]][0])
            found.append((-sum(own[k][1] for k in path), -len(path), leaf, path[::-1]))
        want += [(tree, leaf, i + 1, path) for i, (_, _, leaf, path) in enumerate(sorted(found))]
    assert sorted((x["tree"], x["leaf"], x["rank"], x["path"]) for x in chat.paths(nodes, None).collect()) == sorted(want)
    long = spark.range(10_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, ' \U0001f600 <|im_end|>') as text")
    (got,) = chat.digest(chat.format_trees(chat.from_turns(long))).collect()
    said = [("user" if i % 2 == 0 else "assistant", f"turn {i} \U0001f600 <|im_end|>") for i in range(10_000)]
    loss = "".join(t for role, t in said if role == "assistant")
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == (10_000, sha("".join(f"{a}\n{t}\n" for a, t in said)), len(loss), sha(loss))
