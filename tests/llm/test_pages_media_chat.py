"""HTML extraction on literal pages, media columns byte for byte, tool calls by cases."""

import hashlib
import json
import random
import re
import time
import zlib
from html.parser import HTMLParser

import pytest
from quillforge.llm import chat_formatting as T
from quillforge.llm import html_extraction as H
from quillforge.llm import media as M

TEXT = "This is a long paragraph of the article, with commas, and with enough words in it to count as prose for any reader."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        (f"<nav>menu</nav><article><h1>T &amp; U</h1><p>{TEXT}<br>on<p>{TEXT}</article><footer>f</footer>", f"T & U\n{TEXT} on\n{TEXT}"),
        (f"<article><p><b>{TEXT}<p>two,  \n three &#233; &lt;x&gt;</article>", f"{TEXT}\ntwo, three é <x>"),
        (f"<div id=main><p>{TEXT}</p><p>{TEXT}</p></div><div id='comments'><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div>", f"{TEXT}\n{TEXT}"),
        (f"<article><p>{TEXT}</p><script>var a = '</p>';</script><aside>{TEXT}</aside><form>{TEXT}</form><style>p{{}}</style><!-- <p>no --><p>end.</p></article>", f"{TEXT}\nend."),
        (f"<div class='cookie-notice'><p>{TEXT}</p></div><div class=post-content><p>{TEXT}</p><ul><li>one<li>two</ul></div>", f"{TEXT}\none\ntwo"),
        ("<div><a href=x>link</a> <a href=y>link</a></div>" * 3 + f"<div><p>{TEXT}</p></div>", TEXT),
        (f"<article><div style='display: none'>hidden</div><p aria-hidden=true>h</p><header><h1>Own head</h1></header><p>{TEXT}</p></article>", f"Own head\n{TEXT}"),
        ("<p>unclosed <b>tags <i>everywhere", "unclosed tags everywhere"),
        ("<", "<"),
        (f"<article><div role=navigation>skip</div><p>{TEXT}</p><div class=advert>{TEXT}</div></article>", TEXT),
        # names that tell of a layout, and a form around all
        (f"<div class='content no-sidebar'><p>{TEXT}</p></div>", TEXT),
        (f"<body><div class='page with-nav'><p>{TEXT}</p></div><nav>x</nav></body>", TEXT),
        (f"<div class='post comments-open'><p>{TEXT}</p></div><div class=comments><p>{TEXT}</p><p>{TEXT}</p></div>", TEXT),
        (f"<body><form action=/><p>{TEXT}</p><div class=menu>a b</div><p>{TEXT}</p><select><option>x</select></form></body>", f"{TEXT}\n{TEXT}"),
        (f"<div class='sidebar'><p>{TEXT}</p><p>{TEXT}</p></div><footer>end</footer>", f"{TEXT}\n{TEXT}"),
        (f"<div><p>{TEXT}</p><p>{TEXT}</p><form><label>Mail</label><p>write, to, us</p></form></div>", f"{TEXT}\n{TEXT}"),
        (f"<div class=comments><p>{TEXT}</p></div>", ""),
        (f"<div><p>{TEXT} <span class=advert>buy, buy, buy</span> <b><i class=menu>x</i>end</b></p><p>{TEXT}</p></div>", f"{TEXT} end\n{TEXT}"),
        # all sections of the article, its lists and bare text; foreign words in a wrapper's name
        (f"<body><nav>x</nav><div class=content><section><p>{TEXT}</p><p>{TEXT}</p></section><section><h2>Two</h2><p>Short.</p></section><section><p>{TEXT}</p></section></div><footer>f</footer></body>", f"{TEXT}\n{TEXT}\nTwo\nShort.\n{TEXT}"),
        (f"<body><div class=content><div><p>{TEXT}</p><p>{TEXT}</p></div><p>{TEXT}</p><ul><li>one<li>two</ul>bare <i>text</i> here<div>{TEXT}</div></div></body>", f"{TEXT}\n{TEXT}\n{TEXT}\none\ntwo\nbare text here\n{TEXT}"),
        (f"<body><div><div><p>{TEXT}</p><p>{TEXT}</p></div><div><a href=1>Read</a> <a href=2>this</a></div><div>The end</div></div></body>", f"{TEXT}\n{TEXT}\nThe end"),
        (f"<body><nav>x</nav><div class='newsletter issue-12'><h1>Issue</h1><p>{TEXT}</p></div></body>", f"Issue\n{TEXT}"),
        (f"<body><div class='has-comments ads'><p>{TEXT}</p><p>{TEXT}</p></div><footer>f</footer></body>", f"{TEXT}\n{TEXT}"),
        (f"<body><div class=post><p>A short post.</p></div><div class='comments big'><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div></body>", "A short post."),
        (f"<body><div class=top><h1>Dinner</h1></div><div class=content><p>{TEXT}</p><ul class=menu-list><li>Soup<li>Fish</ul><ul class=menu><li><a href=1>Home</a></ul></div></body>", f"Dinner\n{TEXT}\nSoup\nFish"),
        (f"<body><article><div><section><p>{TEXT}</p><p>{TEXT}</p></section><section><p>Few words.</p></section></div></article><div class=box><p>{TEXT}</p></div></body>", f"{TEXT}\n{TEXT}\nFew words."),
        (f"<body><div class=part><p>{TEXT}</p><p>{TEXT}</p></div><div class=part><p>Few words</p></div><div class=other><p>Not this</p></div></body>", f"{TEXT}\n{TEXT}\nFew words"),
    ],
)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 20000 + f"<p>{TEXT}") == TEXT
    many = [f"{TEXT} {i}" for i in range(3000)]
    assert H.main_text("<article>" + "".join(f"<p>{x}</p>" for x in many) + "</article>") == "\n".join(many)


@pytest.mark.parametrize("page", ["<span>{n}<p>{n}", "<span>{n}</div>{n}", "<p><table><td><span>{n}<p></p>{n}", "<ul>{n}<li>{n}", "<div><p><b>{n}", "<table><tr><td>{n}", "<a href='{n}", "<!-- {n}", "<b class={n}>"])
def test_broken_pages_take_linear_time(page):
    """60,000 of each tag: seconds where time is linear, minutes where it is quadratic."""
    page = re.sub(r"((?:<[^{]*>)?)\{n\}", lambda m: (m[1] or "<") * 60_000, page) + TEXT
    start = time.process_time()
    H.main_text(page)
    assert time.process_time() - start < 15


class Plain(HTMLParser):
    """The same rules, written plainly, for well-formed pages: lists for elements, recursion, every sum worked out anew."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = ["#root", [], None, False]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attributes):
        names = " ".join(v or "" for k, v in attributes if k in ("class", "id"))
        out = tag in H.NEVER or bool(H.NEVER_NAMED.search(H.LAYOUT.sub(" ", names)))
        new = [tag, [], self.at, out]
        self.at[1].append(new)
        if tag not in H.VOID:
            self.at = new

    def handle_endtag(self, tag):
        assert self.at[0] == tag, "not well-formed"
        self.at = self.at[2]

    def handle_data(self, data):
        self.at[1].append(data)

    def all(self, node):
        return [node, *(x for k in node[1] if isinstance(k, list) and not k[3] for x in self.all(k))]

    def size(self, node, in_links, linked=False):
        """Characters below a node, of all or of those in links."""
        linked = linked or node[0] == "a"
        return sum(len(" ".join(k.split())) * (linked or not in_links) if isinstance(k, str) else 0 if k[3] else self.size(k, in_links, linked) for k in node[1])

    def density(self, node):
        whole = self.size(node, False)
        return self.size(node, True) / whole if whole else 0

    def own(self, node):
        return " ".join("".join(k if isinstance(k, str) else "" if k[3] or k[0] in H.BLOCK else self.raw(k) for k in node[1]).split())

    def raw(self, node):
        return "".join(k if isinstance(k, str) else "" if k[3] or k[0] in H.BLOCK else self.raw(k) for k in node[1])

    def earned(self, node):
        own = self.own(node) if node[0] in H.PARAGRAPH else ""
        return (1 + own.count(",") + min(len(own) / 100, 30)) * (1 - self.density(node)) if own else 0

    def points(self, node):
        shares = {0: 1, 1: 0.5, 2: 0.25, 3: 0.5 / 3}

        def below(n, depth):
            return sum(self.earned(k) * shares[depth] + (below(k, depth + 1) if depth < 3 else 0) for k in n[1] if isinstance(k, list) and not k[3])

        return below(node, 0)

    def text(self):
        scores = [(self.points(n) * (1 - self.density(n)), n) for n in self.all(self.root) if n[0] not in ("#root", "html", "p", "b", "i", "em", "strong", "span", "a") and any(self.earned(x) for x in self.all(n)[1:])]
        most = max(s for s, _ in scores)
        best = next(n for s, n in scores if s == most)
        while best[2][0] in ("article", "main"):
            best = best[2]
        kept = []
        for k in best[2][1]:
            if isinstance(k, str) or k[3]:
                continue
            own = self.own(k)
            if k is best or self.points(k) * (1 - self.density(k)) >= max(10, most / 5):
                kept.append(k)
            elif k[0] in ("p", "h1", "h2") and best[0] not in ("article", "main", "body"):
                d = self.density(k)
                if k[0] != "p" or (len(own) > 80 and d < 0.25) or (own.endswith((".", "!", "?")) and not d):
                    kept.append(k)
        lines = []
        for k in kept:
            lines += self.lines(k)
        return "\n".join(lines)

    def lines(self, node):
        """The blocks of a node in page order."""
        out, part = [], ""

        def visit(n):
            nonlocal part
            for k in n[1]:
                if isinstance(k, str):
                    part += k
                elif k[3]:
                    continue
                elif k[0] == "br":
                    part += " "
                elif k[0] in H.BLOCK:
                    flush()
                    visit(k)
                    flush()
                else:
                    visit(k)

        def flush():
            nonlocal part
            if part.split():
                out.append(" ".join(part.split()))
            part = ""

        visit(node)
        flush()
        return out


def generated_page(seed):
    """A well-formed page and the blocks of its article."""
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(["one", "two,", "three", "caf\u00e9,", "a", "longer-word", "so."]) for _ in range(n)) + " end."
    link = lambda: f"<a href='/{rng.randrange(99)}'>{prose(2)}</a>"
    blocks = [prose(rng.randint(15, 90)) for _ in range(rng.randint(2, 9))]
    inner = [f"<p>{b}</p>" if rng.random() < 0.7 else f"<p>{b[: len(b) // 2]}<b>{b[len(b) // 2 :]}</b></p>" for b in blocks]
    if rng.random() < 0.3:
        inner.insert(1, f"<div class=advert><p>{prose(30)}</p></div>")
    article = rng.choice(["<article>%s</article>", "<div class='post-content'>%s</div>", "<main><section>%s</section></main>", "<div class='entry no-sidebar'><div>%s</div></div>"]) % "".join(inner)
    junk = [f"<nav><ul><li>{link()}</li><li>{link()}</li></ul></nav>", f"<aside><p>{prose(40)}</p></aside>", f"<div class=comments><p>{prose(60)}</p><p>{prose(50)}</p></div>", f"<footer><p>{prose(20)}</p></footer>", f"<div>{link()} {link()} {link()}</div>", f"<script>var x = '{prose(30)}';</script>"]
    before, after = rng.sample(junk, rng.randint(0, 3)), rng.sample(junk, rng.randint(0, 3))
    return f"<html><head><title>{prose(4)}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>", [" ".join(b.split()) for b in blocks]


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages_against_a_plain_extractor(seed):
    page, blocks = generated_page(seed)
    got = H.main_text(page)
    assert got == Plain(page).text()
    assert got.split("\n") == blocks


def article_page(seed):
    """A page whose article is in parts of any kind, in a wrapper of any name, and its blocks; nothing here is judged by a rule."""
    rng = random.Random(1000 + seed)
    prose = lambda n: " ".join(rng.choice(["one", "two,", "three", "café,", "a", "longer-word", "so."]) for _ in range(n)) + " end."
    truth = []

    def block(tag, n):
        truth.append(prose(n))
        return f"<{tag}>{truth[-1]}</{tag}>"

    def part(kind):
        head = block("h2", 3) if rng.random() < 0.5 else ""
        if kind == "long":
            return head + "".join(block("p", rng.randint(20, 80)) for _ in range(rng.randint(2, 5)))
        if kind == "short":
            return head + block("p", rng.randint(1, 6))
        if kind == "list":
            tag = rng.choice(["ul", "ol", "ul class=menu-list"])
            return f"{head}<{tag}>{''.join(block('li', rng.randint(1, 5)) for _ in range(3))}</{tag[:2]}>"
        return head + rng.choice([lambda: block("pre", 8), lambda: block("blockquote", 8), lambda: f"<table><tr>{block('td', 2)}{block('td', 3)}</tr></table>"])()

    title = ""
    if rng.random() < 0.5:
        title = rng.choice(["%s", "<div class=headline>%s</div>"]) % block("h1", 4)
    kinds = ["long", *rng.choices(["long", "short", "list", "other"], k=rng.randint(0, 4))]
    rng.shuffle(kinds)
    box = rng.choice(["%s", "<section>%s</section>", "<div>%s</div>", "<div class=part>%s</div>"])
    body = "".join(box % part(k) for k in kinds)
    wrapper = rng.choice(["<div class=content>%s</div>", "<div id=wrap><div class='post-text'>%s</div></div>", "<article>%s</article>", "<article><div>%s</div></article>", "<div class='newsletter issue-12'>%s</div>", "<div class='has-comments ads'>%s</div>", "<div id=x><div>%s</div></div>", "<form action=/><div>%s</div></form>"])
    if wrapper.startswith("<article"):
        title, truth[:] = "", truth[1:] if title else truth  # an article brings its own heading
    link = lambda: f"<a href='/{rng.randrange(99)}'>{prose(2)}</a>"
    junk = [f"<nav><ul><li>{link()}</li></ul></nav>", f"<aside><p>{prose(40)}</p></aside>", f"<div class=comments><p>{prose(60)}</p><p>{prose(50)}</p></div>", f"<footer><p>{prose(20)}</p></footer>", f"<div>{link()} {link()}</div>"]
    return f"<html><body>{''.join(rng.sample(junk, 2))}{title}{wrapper % body}{''.join(rng.sample(junk, 2))}</body></html>", [" ".join(b.split()) for b in truth]


@pytest.mark.parametrize("seed", range(150))
def test_articles_of_many_parts_are_whole(seed):
    page, blocks = article_page(seed)
    assert H.main_text(page).split("\n") == blocks


def test_pages_frame(spark):
    kind = "page_id long, url string, html string, text string"
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", f"<p>{TEXT}", "x"), (None, None, "", None)], kind)
    assert sorted((r.page_id or 0, r.text) for r in H.extract_pages(df).collect()) == [(0, ""), (1, ""), (1, TEXT)]
    assert H.extract_pages(df.limit(0)).collect() == []


def test_png_round_trip():
    for raw in (b"", b"a", b"x" * 576, bytes(range(256)) * 9):
        payload = M.padded(raw)
        assert len(payload) % 576 == 0 and payload.startswith(raw) and M.from_png(M.to_png(payload)) == payload
    assert M.feature(M.padded(b"")) == "255000:1:0000000000000000"


def test_media_columns(spark):
    texts = {1: None, 2: "", 3: "é" * 300, 4: "x" * 50_000, 5: "é" * 300}
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()] + [(None, "n", 7), (3, "é" * 300, 7)], "doc_id long, text string, media int").repartition(3)
    rows = M.media_digests(M.media_columns(df)).collect()
    assert len(rows) == 7
    for r in rows:
        raw = (texts[r.doc_id] or "").encode() if r.doc_id else b"n"
        p = M.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert len({tuple(r)[2:] for r in rows if r.doc_id in (3, 5)}) == 1
    assert M.media_columns(df.limit(0)).collect() == []


def test_ranges_read_each_member_once_and_retry_by_offset(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i} " * 200) for i in range(40)], "doc_id long, text string").coalesce(1)
    index = str(tmp_path / "index")
    M.write_archives(df, f"file://{tmp_path}/archives", archive_bytes=5000).write.parquet(index)
    reader = M.ArchiveReader({"path": f"file://{index}", "rangebytes": "700", "batchbytes": "1000"})
    parts = reader.partitions()
    assert len(parts) > 5
    assert sorted(i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()) == list(range(40))

    class Flaky:
        """A handle whose first reads of members fail or give wrong bytes."""

        def __init__(self, f):
            self.f, self.n = f, 0

        def read_at(self, size, at):
            self.n += 1
            if self.n == 4:
                raise OSError("gone")
            return b"?" * size if self.n == 5 else self.f.read_at(size, at)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    opened, handles = M.ArchiveReader._open, []

    def flaky(self, archive):
        f = opened(self, archive)
        handles.append(archive)
        return Flaky(f) if len(handles) == 1 else f

    monkeypatch.setattr(M.ArchiveReader, "_open", flaky)
    whole = max(parts, key=lambda p: p.size)
    got = [b for b in reader.read(M.Range(whole.archive, 0, whole.size, whole.size))]
    assert sorted(x for b in got for x in b.column(3).to_pylist())[-3:] == [1, 2, 2] and len(handles) == 3


SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}
KIND = "conv_id long, turn long, seq int, role string, text string, call_id string, name string, arguments string, position int, kind string"


def lines(spark, events):
    df = spark.createDataFrame([(*e, 0, "k") for e in events], KIND).repartition(3)
    return [(r.conv_id, r.position, r.kind, r.call_id, r.linked, "; ".join(r.errors), json.loads(r.json)) for r in T.link_tool_calls(df, SCHEMAS).orderBy("conv_id", "position").collect()]


def call(conv, turn, ident, arguments, name="add", seq=0):
    return (conv, turn, seq, "assistant", None, ident, name, arguments)


def result(conv, turn, ident, text="r"):
    return (conv, turn, 0, "tool", text, ident, None, None)


def test_calls_link_and_validate(spark):
    got = lines(spark, [
        (1, 0, 0, "user", 'say "é"\n', None, None, None), call(1, 1, "x", '{"b": ["s"], "a": 1.0}'), result(1, 2, "x"), call(1, 3, "y", '{"a": -1, "c": 2}'), call(1, 4, "z", "{broken"),
        result(1, 5, "none"), call(1, 6, "x", '{"a": 2}'), call(1, 7, "w", "{}", "gone"), (2, 0, 0, None, None, None, None, None), result(2, 1, "x"),
    ])
    assert [(g[2], g[3], g[4], g[5]) for g in got] == [
        ("message", None, False, ""), ("call", "x", True, ""), ("result", "x", True, ""), ("call", "y", False, "no result; $.a: out of bounds; $.c: unknown"), ("call", "z", False, "no result; arguments: not JSON"),
        ("result", "none", False, "no call"), ("call", "x", False, "duplicate id"), ("call", "w", False, "no result; unknown tool"), ("message", None, False, ""), ("result", "x", False, "no call"),
    ]
    assert got[1][6] == {"arguments": {"a": 1, "b": ["s"]}, "id": "x", "name": "add", "role": "assistant", "type": "tool_call"}


def test_calls_are_ordered_by_what_they_need(spark):
    got = lines(spark, [
        result(1, 0, "b"), call(1, 1, "a", '{"a": "$ref:c"}'), call(1, 1, "b", '{"a": "$ref:a"}', seq=1), call(1, 1, "c", '{"a": 1}', seq=2), result(1, 2, "a"), result(1, 2, "c"),
        call(2, 0, "p", '{"a": "$ref:q"}'), call(2, 1, "q", '{"a": "$ref:p"}'), call(2, 2, "r", '{"a": "$ref:gone"}'),
    ])
    assert [(g[2], g[3]) for g in got if g[0] == 1] == [("call", "c"), ("call", "a"), ("call", "b"), ("result", "b"), ("result", "a"), ("result", "c")]
    assert [(g[3], "cyclic" in g[5]) for g in got if g[0] == 2] == [("p", True), ("q", True), ("r", False)]


def test_chat_edges(spark):
    assert lines(spark, []) == []
    assert T.canonical({"b": [1.0, 1e300, "é "], "a": None}) == '{"a":null,"b":[1,1e+300,"é "]}'
    assert T.violations([1], {"type": "array", "maxItems": 0}) == ["$: length"] and T.violations(True, {"type": "integer"}) == ["$: not integer"]
    assert T.violations("ab", {"type": ["string", "null"], "pattern": "^b", "enum": ["ab"], "const": "c"}) == ["$: not the constant", "$: pattern"]


def test_plain_conversations(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, "user", "")], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.kind, r.linked, "; ".join(r.errors)) for r in T.link_tool_calls(T.turns_as_calls(df), T.REPLY).collect()}
    assert got == {0: ("message", False, ""), 1: ("call", True, ""), 2: ("result", True, ""), 3: ("call", False, "no result; $.prompt: length")}


def test_rows_without_turn_keep_their_text(spark):
    df = spark.createDataFrame([(1, None, "user", "prompt"), (1, None, "assistant", "answer"), (1, 1, "user", "hi"), (None, 1, "user", "alone"), (1, 1, None, "who")], "conv_id long, turn long, role string, text string")
    got = sorted((str(r.conv_id), str(r.turn), r.kind, r.json) for r in T.link_tool_calls(T.turns_as_calls(df), T.REPLY).collect())
    assert got == [
        ("1", "1", "call", '{"arguments":{"prompt":"hi","turn":1},"id":"turn-1","name":"reply","role":"assistant","type":"tool_call"}'), ("1", "1", "message", '{"content":"who","role":null}'),
        ("1", "None", "message", '{"content":"answer","role":"assistant"}'), ("1", "None", "message", '{"content":"prompt","role":"user"}'),
        ("None", "1", "call", '{"arguments":{"prompt":"alone","turn":1},"id":"turn-1","name":"reply","role":"assistant","type":"tool_call"}'),
    ]


def test_long_conversations_and_chains(spark):
    """A chain of 400 calls of one turn in reverse, one over 300 turns, and a conversation of 3,000 messages."""
    n = 400
    events = [call(1, 0, f"c{i}", json.dumps({"a": f"$ref:c{i - 1}"} if i else {"a": 1}), seq=n - i) for i in range(n)]
    events += [call(2, i, f"t{i}", json.dumps({"a": f"$ref:t{i - 1}"} if i else {"a": 1})) for i in range(300)]
    events += [(3, i, 0, "user", f"m{i}", None, None, None) for i in range(3000)]
    got = lines(spark, events)
    assert [g[3] for g in got if g[0] == 1] == [f"c{i}" for i in range(n)]
    assert [g[3] for g in got if g[0] == 2] == [f"t{i}" for i in range(300)]
    assert [(g[1], g[6]["content"]) for g in got if g[0] == 3] == [(i + 1, f"m{i}") for i in range(3000)]


def plain_links(events):
    """(conversation, position, kind, id, linked, repeated, cyclic) by loops; events are distinct in what orders them."""
    out = []
    for conv in {e[0] for e in events}:
        own = [e for e in events if e[0] == conv]
        kind = lambda e: "call" if e[6] is not None and e[5] is not None else "result" if e[3] == "tool" else "message"
        first = {}
        for e in sorted((e for e in own if kind(e) != "message" and e[5] is not None), key=lambda e: (e[1], e[2])):
            first.setdefault((kind(e), e[5]), e)
        calls = {i: e for (k, i), e in first.items() if k == "call"}
        refs = {i: [r for r in set(re.findall(r'"\$ref:([^"]+)"', e[7])) if r in calls] for i, e in calls.items()}
        at, level = {}, {}
        while True:
            ready = [i for i in calls if i not in level and all(r in level for r in refs[i])]
            if not ready:
                break
            for i in ready:
                at[i], level[i] = max([calls[i][1], *(at[r] for r in refs[i])]), max([0, *(level[r] + 1 for r in refs[i])])
        cyclic = set(calls) - set(level)
        rows = []
        for e in own:
            k, i = kind(e), e[5]
            when, rank = e[1], 0
            if k != "message" and i in calls:
                when = max(e[1], at.get(i, calls[i][1]))
                rank = 2 * level.get(i, 0) if k == "call" else 0 if e[1] > at.get(i, calls[i][1]) else 2 * level.get(i, 0) + 1
            rows.append(((when, rank, e[1], e[2], k), e, k, i))
        for n, (_, e, k, i) in enumerate(sorted(rows, key=lambda r: r[0])):
            mine = k != "message" and i is not None and first[k, i] is e
            other = k != "message" and (("result" if k == "call" else "call"), i) in first
            out.append((conv, n + 1, k, i, mine and other, k != "message" and i is not None and not mine, k == "call" and i in cyclic))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_links_against_plain_version(spark, seed):
    rng = random.Random(seed)
    events = []
    for conv in range(6):
        for i in range(rng.randint(0, 25)):
            ident, turn = f"i{rng.randrange(8)}", i // rng.choice([1, 3])
            what = rng.random()
            if what < 0.5:
                events.append(call(conv, turn, ident, json.dumps({"a": f"$ref:i{rng.randrange(8)}", "b": [f"$ref:i{rng.randrange(12)}"]} if rng.random() < 0.6 else {"a": 1}), seq=i))
            elif what < 0.8:
                events.append((conv, turn, i, "tool", f"r{i}", ident if rng.random() < 0.9 else None, None, None))
            else:
                events.append((conv, turn, i, "user", f"m{i}", None, None, None))
    got = sorted(((g[0], g[1], g[2], g[3], g[4], "duplicate id" in g[5], "cyclic" in g[5]) for g in lines(spark, events)), key=str)
    assert got == plain_links(events)


def test_equal_rows_of_chats(spark):
    """Of equal calls one is linked, the others are duplicates; equal messages all stay."""
    events = [call(1, 0, "x", '{"a":1}')] * 3 + [result(1, 1, "x")] * 2 + [(1, 2, 0, "user", "m", None, None, None)] * 2
    got = lines(spark, events)
    assert [(g[2], g[4], g[5]) for g in got] == [("call", True, "")] + [("call", False, "duplicate id")] * 2 + [("result", True, ""), ("result", False, "duplicate id")] + [("message", False, "")] * 2


def test_directory_is_read_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1)
    index = str(tmp_path / "index")
    M.write_archives(df, f"file://{tmp_path}/archives").write.parquet(index)
    reader, opened, real = M.ArchiveReader({"path": f"file://{index}"}), [], M.ArchiveReader._open

    class Broken:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

        def read_at(self, size, at):
            raise OSError("not yet")

    def flaky(self, archive):
        opened.append(archive)
        return Broken() if len(opened) < 2 else real(self, archive)

    monkeypatch.setattr(M.ArchiveReader, "_open", flaky)
    whole = reader.partitions()[0]
    assert len(reader._directory(flaky(reader, whole.archive), whole)) == 5 and len(opened) == 2
    monkeypatch.setattr(M.ArchiveReader, "_open", lambda self, archive: Broken())
    with pytest.raises(OSError, match="directory"):
        list(reader.read(whole))


def test_media_of_a_very_long_text(spark):
    """A text of 5 MB beside short ones, with columns named like the archive's."""
    texts = {1: "é~" * 1_700_000, 2: "short", 3: "x" * 576}
    df = spark.createDataFrame([(i, t, b"m", 9, "a") for i, t in texts.items()], "doc_id long, text string, media binary, n_bytes int, archive string")
    rows = M.media_digests(M.media_columns(df)).collect()
    for r in rows:
        p = M.padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest())
    assert len(rows) == 3
