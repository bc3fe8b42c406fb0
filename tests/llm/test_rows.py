"""Sharding, HTML, chat, language ID and media against brute force or exact round trips."""

import json
import random
import re
import struct
import zlib
from collections import Counter
from hashlib import md5, sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from setloom.llm import chat, html, langid, media, sharding
from setloom.llm.queries import op6_html, op7_chat, op9_language_id, op10_media

ODD = [None, "", " ", "a", "x\0y", "é" * 70000, "RIFF BM GIF89a %PDF-1 \x1f\x8b\x08 PK\x03\x04"]


def brute_fill(names, slots):
    perms = []
    for n in names:
        h = md5(n.encode()).hexdigest()
        perms.append([(int(h[:8], 16) % slots + j * (int(h[8:16], 16) % (slots - 1) + 1)) % slots for j in range(slots)])
    owner, turn = {}, 0
    while len(owner) < slots:
        i = turn % len(names)
        owner[next(s for s in perms[i] if s not in owner)] = names[i]
        turn += 1
    return [owner[s] for s in range(slots)]


def test_fill_is_fair_and_stable():
    names = sharding.shard_names(7)
    table = sharding.fill(names, 211)
    assert table == brute_fill(names, 211)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill(names[:-1], 211)
    assert sum(a != b and a != names[-1] for a, b in zip(table, fewer)) < 0.25 * 211
    for bad in ((names, 210), (["a", "a"], 211), ([], 211)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_place(spark, tmp_path):
    rows = [(i % 50, f"t{i}") for i in range(60)] + [(None, None), (None, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS shard", "1 AS slot")
    out = sharding.place(df).collect()
    table = sharding.fill(sharding.shard_names())
    slot = lambda i, t: int(md5((str(i) if i is not None else "text:" + (t or "")).encode()).hexdigest()[:15], 16) % sharding.SLOTS
    assert Counter(map(tuple, out)) == Counter((i, s := slot(i, t), table[s]) for i, t in rows)
    assert sharding.place(df.limit(0)).count() == 0
    clean = df.select("doc_id", "text")
    sharding.write_shards(clean, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)
    clash = df.selectExpr("doc_id", "text", "'z' AS shard", "5 AS _salt", "6 AS salt", "slot")
    assert sharding.write_shards(clash, str(tmp_path / "c")) == "shard_"
    back = spark.read.parquet(str(tmp_path / "c"))
    assert Counter(map(tuple, back.select(*clash.columns).collect())) == Counter(map(tuple, clash.collect()))
    assert {(r["doc_id"], r["text"], r["shard_"]) for r in back.collect()} == {(i, t, table[slot(i, t)]) for i, t in rows}


PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site name</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><div class="sidebar"><ul><li><a href=x>one</a></li></ul></div>%s
<section id="comments"><p>Reader says a lot of words here, more than one would think, again and again and again.</p></section>
<form><label>Mail</label><input></form><footer>&copy; X</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article><header><h1>Head &amp; line</h1></header>{}</article>", "<main><h1>Head &amp; line</h1>{}</main>", "<div class='post'><h1>Head &amp; line</h1>{}</div>"])
def test_page_layouts(wrap):
    body = "<p>One <b>bold</b>\n  word, and quite a few more words so that this is text.<p>Two&nbsp;x.<div class=ad>Buy</div><ul><li>item one of the list</ul><p>" + "long text " * 40
    want = "Head & line One bold word, and quite a few more words so that this is text. Two x. item one of the list " + " ".join(["long text"] * 40)
    assert html.main_text(PAGE % wrap.format(body)).replace("\xa0", " ") == want


@pytest.mark.parametrize("page", [
    "<form id=f><div class='layout-sidebar-right'><article><p>Text here.</article></div></form>",
    "<div class=sidebar><a href=x>l</a></div><div role=main><p>Text <i>here</i>.<div class='related'>No</div></div>",
    "<nav><a href=x>never closed<main><h1>Text</h1><p>here.</main>",
    "<article><p>Text <span hidden>no</span> here.</p><div style='display: none'>no</div></article><article class=comment><p>no</article>",
    "<form><p>Text here.</form>",
])
def test_wrapped_pages(page):
    assert html.main_text(page) == "Text here."
    assert html.main_text("<nav><a href=x>Menu</a></nav><header>Site</header><footer>f</footer>") == ""


def test_landmarks_are_evidence():
    body = [f"Paragraph {i} " + "of the body, with words enough to be text. " * 8 for i in range(6)]
    page = "<body><div>" + "".join(f"<div><p>{p}</p></div>" for p in body) + "</div>%s</body>"
    want = " ".join(" ".join(body).split())
    assert html.main_text(page % "<article class=card><h3><a href=x>Other story</a></h3><p>A short teaser.</article>") == want
    assert html.main_text(page % "<main><ul><li><a href=x>one</a><li><a href=y>two</a></ul></main>") == want
    links = "".join(f"<li><a href=x>Link number {i}</a>" for i in range(5))
    assert html.main_text(f"<article><p>{body[0]}</p><ul>{links}</ul><p>Short end.</p><table><tr><td>12<td><a href=x>cell</a></table></article><div>Imprint</div>") == f"{body[0].strip()} Short end. 12 cell"
    assert html.main_text("<article><p>A short story.</p></article><div>Some words of an imprint.</div>") == "A short story."


def test_containers_side_by_side_stand_together():
    body = [" ".join([f"Words of block {i} go on."] * 22) for i in range(4)]
    divs = "".join(f"<div>{p}</div>" for p in body)
    lead, end = "A lead of a few words.", "The closing block has ninety characters or so, and is text like all the others before it."
    top = "<div id=top><div>Some words about the site</div></div>"
    text = " ".join([lead, *body, end])
    blocks = f"<div>{lead}</div>{divs}<div>{end}</div>"
    links = "<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>"
    assert html.main_text(f"<body>{blocks}</body>") == text
    assert html.main_text(f"<body>{top}<div class=post>{blocks}{links}</div></body>") == text
    assert html.main_text(f"<body>{top}<div><div><h1>Title</h1></div><div>{' '.join(f'<p>{p}</p>' for p in body)}</div><ul><li>item one<li>item two</ul></div></body>") == " ".join(["Title", *body, "item one item two"])
    assert html.main_text(f"<body>{top}<div><div>{body[0]}</div><table><tr><td>a<td>1</table><section>{end}</section></div></body>") == f"{body[0]} a 1 {end}"
    assert html.main_text(f"<body>{links}</body>") == ""
    assert html.main_text(f"<body>{top}<div><h1>Title</h1><div>{divs}</div><div>{end}</div></div></body>") == " ".join(["Title", *body, end])
    long = " ".join(body * 5)
    assert html.main_text(f"<body><div><div><p>{long}</p><p>{end}</p></div><div><p>{body[0]}</p><p>{lead}</p></div></div></body>") == " ".join([long, end, body[0], lead])


@pytest.mark.parametrize("part", ["<div class='share-price-analysis'>%s</div>", "<section id=related-work><h2>Work</h2>%s</section>", "<div class='commentary'>%s</div>", "<p><math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> %s"])
def test_names_of_the_subject_are_no_boilerplate(part):
    body = "Words of the story go on and on. " * 12
    for page in ("<nav><a href=x>Menu</a></nav><article><p>{0}</p>{1}<p>{0}</p></article><div class='comments-list'><p>{0}</div>", "<body><div><p>{0}</p>{1}<p>{0}</p></div><div class='reader-comments'><p>{0}</div></body>"):
        text = html.main_text(page.format(body, part % "The part in the middle."))
        assert text.count("The part in the middle.") == 1 and text.count("Words of the story") == 24
    assert html.main_text("<article><p>As <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> says.</article>") == "As E=m says."


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=40))
def test_smoothing_and_threshold_equal_brute_force(values):
    import math

    import numpy as np

    weight = [math.exp(-d * d / 2) for d in range(-3, 4)]
    at = lambda i: values[min(max(i, 0), len(values) - 1)]
    want = [sum(w * at(i + d) for w, d in zip(weight, range(-3, 4))) / sum(weight) for i in range(len(values))]
    assert html.smoothed(np.array(values)) == pytest.approx(want, rel=1e-9, abs=1e-9)
    cut = html.threshold(np.array(values))
    low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
    assert min(values) <= cut <= max(values)
    if len(set(values)) > 1:
        means = sum(low) / len(low), sum(high) / len(high)
        assert low and high and (means[0] + means[1]) / 2 == pytest.approx(cut, rel=1e-6, abs=1e-6)
        assert all(abs(v - means[0]) <= abs(v - means[1]) + 1e-6 * max(values) for v in low)


def test_unclosed_and_stray_tags_take_linear_time():
    import time

    def took(n):
        page = "<section><article>" + "<div>" * n + "</section></span></td></p>" * n + "text</article>"
        began = time.process_time()
        assert html.main_text(page) == "text"
        return time.process_time() - began

    took(500)
    assert took(32_000) < 24 * max(took(4_000), 0.02)


def test_pages_table(spark, sf):
    import html as std
    import re

    pages = {r["page_id"]: (r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = op6_html(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        article = re.search("<article>(.*)</article>", pages[r["page_id"]][1], re.S)[1]
        want = " ".join(std.unescape(re.sub("<[^>]+>", " ", article)).split())
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]][0], want, len(want))


def test_odd_pages(spark):
    pages = [None, "", "<p>", "plain words only", "<article><p>cut off &am", "<script>x", "<b>" * 5000 + "x", "<article>" + "<p>w</p>" * 60000, "</div></p><article><p>a</div>b</article>"]
    df = spark.createDataFrame([(i, None, p) for i, p in enumerate(pages)], "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    assert got[0] == got[1] == got[2] == got[5] == ("", 0)
    assert got[3][0] == "plain words only" and got[4][0] == "cut off &am" and got[7][1] == 2 * 60000 - 1 and got[8][0] == "a b"
    assert html.extract(df.limit(0)).count() == 0


def test_topological_order():
    assert chat.topological(["c", "b", "a"], [["b"], ["a"], ["x"]]) == [2, 1, 0]
    assert chat.topological(["a", "b", "c", "d"], [["b"], ["a"], [], ["a"]]) == [None, None, 0, None]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=12))
def test_topological_is_valid(edges):
    ids = [str(i) for i in range(8)]
    after = [[str(b) for a, b in edges if a == i] for i in range(8)]
    place = chat.topological(ids, after)
    done = [p for p in place if p is not None]
    assert sorted(done) == list(range(len(done)))
    for a, b in edges:
        assert place[a] is None or place[b] is not None and place[b] < place[a]


def test_tagged_calls(spark):
    schema = {"add": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "maximum": 5}}}}
    call = lambda **c: f"<tool_call>{json.dumps(c)}</tool_call>"
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "so " + call(id="b", name="add", arguments={"x": 9}, after=["a"]) + call(id="a", name="add", arguments={"x": 1}) + "<tool_call>{broken</tool_call>"),
        (1, 2, "tool", json.dumps([{"id": "a", "content": "é\n"}, {"id": "zz", "content": 1}])),
        (1, 3, "tool", json.dumps({"id": "a", "content": "late"})),
        (2, 0, "assistant", call(id="a", name="sub", arguments={})),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS status", "2 AS json")
    out = {(r["conv_id"], r["call_id"]): r for r in chat.link_tool_calls(df, schema).collect()}
    assert len(out) == 5
    a, b = out[1, "a"], out[1, "b"]
    assert (a["position"], a["status"], a["valid"], a["json"]) == (0, "linked", True, '{"arguments":{"x":1},"id":"a","name":"add","result":"é\\n"}')
    assert (b["position"], b["status"], b["error"], json.loads(b["json"])["result"]) == (1, "unanswered", "$.x: out of range", None)
    assert out[1, None]["error"] == "malformed" and out[1, "zz"]["status"] == "orphan" and out[2, "a"]["status"] == "unanswered"
    assert chat.link_tool_calls(df.limit(0), schema).count() == 0


def test_schema_violations():
    v = chat.violation
    assert v({"a": [1, "x"]}, {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer"}}}}) == "$.a[1]: not integer"
    assert v("q", {"enum": ["a"]}) == "$: not in enum" and v(True, {"type": "integer"}) and v(None, {"type": "null"}) is None
    assert v("ab", {"pattern": "^b"}) == "$: pattern" and v(3.0, {"type": "integer"}) is None


def brute_link(messages, schemas):
    calls, results = [], {}
    for conv, turn, role, text in messages:
        found, given = chat.tagged_events(role, turn, text or "")
        calls += [(conv, turn, *c) for c in chat.checked(found, schemas)]
        for i, (k, v) in enumerate(given):
            results.setdefault((conv, k) if conv is not None and k is not None else object(), []).append(((turn is not None, turn, i, v), conv, turn, k, v))
    out = [(conv, turn, k, p, e, results[conv, k] if k is not None and conv is not None and (conv, k) in results else None) for conv, turn, k, _, p, e in calls]
    rows = [(conv, turn, k, p, "linked" if r else "unanswered", e) for conv, turn, k, p, e, r in out]
    asked = {(c[0], c[2]) for c in calls if c[0] is not None and c[2] is not None}
    return Counter(rows + [(min(r)[1], min(r)[2], min(r)[3], None, "orphan", None) for key, r in results.items() if key not in asked])


ODD_JSON = ['{"id":1,"name":"f","arguments":{"x":1e999}}', '{"id":2,"name":"f","arguments":{"x":NaN}}', '{"id":3,"name":["f"],"arguments":{}}', '{"id":4,"name":"f","arguments":{"x":1},"after":7}', '{"id":5,"name":"f","arguments":{"x":"\\ud800"}}',
            '{"id":6,"name":"f","arguments":' + "[" * 50_000 + "]" * 50_000 + "}", '{"name":"f","arguments":{"x":1}}', '{"id":null,"name":"f"}', '{"id":[1],"name":"f"}', "7", "[]", "", '{"id":8,"name":"f","arguments":{"x":1e2},"after":[8]}', '{"malformed":1,"id":9}',
            '{"id":"z\\u001f\\u2028\\u0085","name":"f","arguments":{"x":2}}', '{"id":10,"name":"f","arguments":{"x":' + "9" * 5000 + "}}"]


def test_odd_messages_crash_nothing_and_link_nothing_false(spark):
    schema = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}}}
    rows = []
    for conv in (None, -1, 1):
        rows += [(conv, 0, "assistant", f"<tool_call>{c}</tool_call>" * (1 + i % 2)) for i, c in enumerate(ODD_JSON)]
        rows += [(conv, 1, "tool", c) for c in (*ODD_JSON, '{"content":1}', '{"id":null,"content":2}', '{"id":8,"content":3}', '{"id":"8","content":4}', '[{"id":"z\\u001f\\u2028\\u0085","content":"\\u001f"},{"id":77}]', '[{"id":1},2]')]
    rows += [(None, None, "tool", '{"id":8}'), (1, None, "assistant", '<tool_call>{"id":8}</tool_call>'), (1, None, "tool", '{"id":8,"content":"first"}'), (1, 0, "tool", None), (1, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.link_tool_calls(df, schema).collect()
    assert Counter((r["conv_id"], r["turn"], r["call_id"], r["position"], r["status"], r["error"]) for r in got) == brute_link(rows, schema)
    for r in got:
        assert chat.canonical(json.loads(r["json"])) == r["json"]
        assert r["status"] != "linked" or r["conv_id"] is not None and r["call_id"] is not None
    assert {json.loads(r["json"])["result"] for r in got if r["conv_id"] == 1 and r["call_id"] == "8"} == {"first"}
    assert chat.read("[" * 100_000) is None and chat.read("-Infinity") is None


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["id", "name", "arguments", "after", "x"]), x, max_size=4), max_leaves=12))
def test_any_json_is_a_call_or_malformed(value):
    text = json.dumps(value)
    schema = {"f": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}}, "required": ["x"]}, "": {"type": "array"}}
    calls, _ = chat.tagged_events("assistant", 0, f"<tool_call>{text}</tool_call><tool_call>{{\"name\":\"f\",\"arguments\":{text}}}</tool_call>")
    for _, head, place, error in chat.checked(calls, schema):
        assert (place is None) == (error == "cycle") or error == "malformed"
        assert chat.canonical(json.loads(head + "null}")) == head + "null}"
    chat.tagged_events("tool", 0, text)


def test_chat_lines_are_canonical(spark, sf):
    for r in op7_chat(spark, sf).collect():
        assert chat.canonical(json.loads(r["json"])) == r["json"]


def test_language_id(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = op9_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(docs)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in out if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) >= 0.95


def test_language_of_very_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.Classifier(langid.dictionaries(docs))
    short = [r for r in docs.where("lang is not null and size(split(trim(text), ' ')) <= 4").collect() if langid.has_letter(r["text"])]
    found = [model.predict(r["text"]) for r in short]
    assert len(short) > 20 and all(m >= langid.MARGIN for _, _, m in found)
    assert sum(k == r["lang"] for r, (k, _, _) in zip(short, found)) >= 0.9 * len(short)
    assert all(model.predict(t)[2] < langid.MARGIN for t in ("漢字 仮名", "щ", "漢字"))


def test_prediction_equals_brute_force_compression(spark, sf):
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    content = langid.dictionaries(docs)
    model = langid.Classifier(content)
    decided = 0
    for r in docs.where("text is not null").collect():
        words = re.sub(r"[\W\d_]+", " ", r["text"].lower()).encode()
        sizes = {}
        for k, c in content.items():
            plain = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=plain, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[k] = sum(len(packer.compress(words[i : i + 512])) for i in range(0, len(words), 512))
        best = sorted((n, k) for k, n in sizes.items())
        if best[0][0] < best[1][0]:
            decided += 1
            lang, score, margin = model.predict(r["text"])
            assert lang == best[0][1] and margin == pytest.approx((best[1][0] - best[0][0]) / best[0][0])
            assert score == pytest.approx(min(1, 0.5 + 2.5 * margin))
    assert decided > 100


def test_whole_texts_are_learned_and_languages_bounded(spark, monkeypatch):
    long = "der " * 60_000 + "ende"
    rows = [(0, long, "de"), (2, "the end", "en"), (3, "the start", "en")]
    df = spark.createDataFrame([(i, t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, text string, lang string")
    content = langid.dictionaries(df)
    assert all(t.encode() in content[k] for _, t, k in df.collect())
    many = spark.createDataFrame([(i, f"text {'a' * i}", f"l{i % 40}") for i in range(1, 4000)], "doc_id long, text string, lang string")
    some = langid.dictionaries(many, rows=5)
    assert len(some) == 40 and 2 <= sum(c.count(b"text") for c in some.values()) / 40 <= 10
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 39)
    with pytest.raises(ValueError, match="languages"):
        langid.dictionaries(many)


def test_number_signs_are_no_letters(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ² Ⅷ ①", "½a", "́", "ʰ", "漢"])], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, {"en": b"the house", "de": b"das haus"}).collect()}
    assert got[0] == got[2] == "und" and "und" not in (got[1], got[3], got[4])


def test_language_id_odd_rows(spark):
    r = random.Random(1)
    made = [(i, " ".join(r.choices(["the", "house", "with", "water"] if i % 2 else ["das", "haus", "mit", "wasser"], k=40)), "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, None), (101, "", "en"), (102, "123 !!", None), (103, "mit wasser das haus", None), (None, "the water with the house", None), (None, "the water with the house", None)]
    df = spark.createDataFrame(made + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score")
    content = langid.dictionaries(df)
    assert sorted(content) == ["de", "en"]
    got = {}
    for x in langid.identify(df, content).collect():
        got.setdefault(x["doc_id"], []).append((x["lang_pred"], x["score"], x["rejected"]))
    assert got[100] == got[101] == got[102] == [("und", 0.0, True)]
    assert got[103][0][0] == "de" and len(got[None]) == 2 and got[None][0][0] == "en"
    assert sum(got[i][0][0] == lang for i, _, lang in made) == 60
    nothing = langid.identify(df, {}).collect()
    assert {x["lang_pred"] for x in nothing} == {"und"} and sum(x["rejected"] for x in nothing) == 3
    assert langid.identify(df.limit(0), content).count() == 0 and langid.dictionaries(df.limit(0)) == {}


def test_media_table_and_odd_rows(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    outs = op10_media(spark, sf).collect()
    odd = list(enumerate(ODD)) + [(None, "a"), (3, "a")]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'x' AS feature", "1 AS n_bytes")
    for given_rows, out in ((rows, outs), (odd, media.digest(df).collect())):
        want = Counter()
        for i, t in given_rows:
            raw = (t or "").encode()
            padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            want[i, len(raw), len(padded), sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
        assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
        payloads = {r["payload_sha256"] for r in out}
        assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in out}) == len({r["media_sha256"] for r in out}) == len(payloads)
    assert media.digest(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_wav_round_trip(payload):
    stored = media.wav(payload)
    assert media.sniff(stored)[0] == ("audio/wav", 0, len(stored)) and media.samples(stored) == payload


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniff_types_and_carve(spark):
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd12\xff\x003\xff\xd9"
    flac = b"fLaC\x80\0\0\x22" + bytes(34)
    ogg = b"OggS\0" + bytes(21) + b"\x01\x03abc"
    mp4 = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8) + b"mdat"
    pdf = b"%PDF-1.4\nx\n%%EOF"
    kinds = {"image/png": png(), "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"x" * 99), "audio/flac": flac, "application/ogg": ogg, "video/mp4": mp4, "application/pdf": pdf}
    for kind, data in kinds.items():
        assert media.sniff(data)[0] == (kind, 0, len(data)), kind
        for cut in range(1, len(data) - 1):
            assert all(n <= cut for _, _, n in media.sniff(data[:cut]))
    holder = media.wav(b"abc" + png() + b"BM junk" + gif)
    rows = [(1, holder, "image/png"), (2, png(), "image/png"), (3, None, None), (4, b"", "text/plain"), (5, png()[:-5], None)]
    df = spark.createDataFrame(rows, "id int, data binary, declared string")
    out = {r["id"]: r for r in media.sniff_column(df, "data", "declared", ["id"]).collect()}
    assert (out[1]["media_type"], out[1]["was_wrong"]) == ("audio/wav", True)
    assert [(e["media_type"], bytes(e["data"])) for e in out[1]["embedded"]] == [("image/png", png()), ("image/gif", gif)]
    assert (out[2]["media_type"], out[2]["was_wrong"], out[2]["embedded"]) == ("image/png", False, [])
    assert not out[3]["was_wrong"] and out[4]["was_wrong"] and out[5]["media_type"] == media.UNKNOWN


def flac_file(values, extra=b""):
    """A FLAC file of frames of 192 equal samples each, in 16 bits."""
    frames = b""
    for i, v in enumerate(values):
        head = b"\xff\xf8\x10\x08" + bytes((i,))
        body = head + bytes((media._crc(head, media.CRC8, 8),)) + b"\0" + struct.pack(">h", v)
        frames += body + media._crc(body, media.CRC16, 16).to_bytes(2, "big")
    info = struct.pack(">HH", 192, 192) + bytes(6) + (44100 << 44 | 15 << 36 | 192 * len(values)).to_bytes(8, "big") + bytes(16)
    return b"fLaC\0\0\0\x22" + info + b"\x81" + len(extra).to_bytes(3, "big") + extra + frames


def test_true_ends_of_media(spark):
    from binascii import crc32

    assert media._crc(b"123456789", media.CRC8, 8) == 0xF4 and media._crc(b"123456789", media.CRC16, 16) == 0xFEE8 and crc32(b"") == 0
    flac = flac_file([5, -7, 300], b"pad")
    first = b"%PDF-1.4\n1 0 obj\nendobj\nxref\nstartxref\n9\n%%EOF"
    pdf = first + b"\n2 0 obj\nendobj\nxref\nstartxref\n60\n%%EOF"
    for data, kind in ((flac, "audio/flac"), (pdf, "application/pdf")):
        assert media.sniff(data + b"\n" + png() + first) == [(kind, 0, len(data)), ("image/png", len(data) + 1, len(png())), ("application/pdf", len(data) + 1 + len(png()), len(first))]
        assert media.sniff(b"x" + data + data)[:2] == [(kind, 1, len(data)), (kind, 1 + len(data), len(data))]
    assert media.sniff(flac[:-1]) == [] and media.sniff(flac[:60]) == []
    two_scans = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd12\xff\x003\xff\xd0\xff\xda\0\x04ef4\xff\xff\xd9"
    assert media.sniff(two_scans + b"rest") == [("image/jpeg", 0, len(two_scans))]
    rows = [(1, b"ID3 and so on", "audio/mpeg"), (2, b"text", "image/png"), (3, b"text", None), (4, png(), "audio/mpeg")]
    out = {r["id"]: (r["media_type"], r["was_wrong"]) for r in media.sniff_column(spark.createDataFrame(rows, "id int, data binary, declared string"), "data", "declared", ["id"]).collect()}
    assert out == {1: ("audio/mpeg", False), 2: (media.UNKNOWN, True), 3: (media.UNKNOWN, False), 4: ("image/png", True)}
