"""URL filters, media columns, license scans and main text against plain versions."""

import cmath
import hashlib
import io
import math
import random
import re
import time
import wave
import zlib

import numpy as np
import pytest
import regex

from placekeep.llm import langid, licenses, main_text, media, toxicity, url_filter
from placekeep.llm.queries import blocked_hosts

from .helpers import ODD, documents


def plain_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + tail
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.verdict
    listed = any(host == h or host.endswith("." + h) for h in HOSTS)
    return host, path, None, "block" if listed else "allow"


HOSTS = ["casino-win.example.com", "free-bets.example.com", "ÄÖ.com", "b..c"]
URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://WWW.Example.COM/en/1?x=/en/", "http://a.b.example.com/en/", "http://example.com/en", "http://example.com:80/en/",
    "https://x.example.net/es/1", "https://x.example.net/fr/#y", "https://x.example.net/de/", "http://free-bets.example.com?x", "http://m.casino-win.example.com", "http://example.org/a b", "://a.com/", "http://a..com/", "http://ÄÖ.com/x", "http://com#/",
]


@pytest.mark.parametrize("mapped", [0, 2, 100])
def test_urls(spark, monkeypatch, mapped):
    monkeypatch.setattr(url_filter, "MAPPED", max(1, mapped))
    urls = [*URLS, URLS[6], "http://a.b..c/x", "http://.../"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    hosts = spark.createDataFrame([(h, 1) for h in [*HOSTS, "FREE-bets.example.com ", "", None, HOSTS[0]]], "host string, page_id int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, hosts=hosts).collect()}
    assert got == {i: plain_judge(u) for i, u in enumerate(urls)}
    assert sum(v[3] == "block" and v[2] is None for v in got.values()) == 3
    assert url_filter.judge_urls(df.where("page_id < 0"), hosts=hosts).collect() == []
    without = url_filter.judge_urls(df, hosts=hosts.where("page_id < 0")).collect()
    assert without == url_filter.judge_urls(df).collect() and not any(r.verdict == "block" and r.rule is None for r in without)


def test_the_list_of_the_query_is_lower_case():
    assert all(h == h.lower() and h for h in blocked_hosts()) and len(set(blocked_hosts())) == len(blocked_hosts())


def test_digest_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda key: len(key))
    url_filter.write_digest_file({"ab": "block", "cd": "allow", "xyz": "block"}, str(tmp_path / "d"))
    s = url_filter.DigestSet(str(tmp_path / "d"))
    assert s.probe(["cd", "ab", "zz", "xyz", "q"]) == ["allow", "block", None, "block", None]
    url_filter.write_digest_file({}, str(tmp_path / "e"))
    assert url_filter.DigestSet(str(tmp_path / "e")).probe(["a"]) == [None]


def test_media_round_trip(spark):
    got = media.with_media(documents(spark, ODD), keep_media=True).collect()
    assert len(got) == len(ODD)
    for r in got:
        raw = (ODD[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, len(raw)) and r.payload_bytes - len(raw) < 192 + (not raw)
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            back = w.readframes(w.getnframes())
        assert back == raw + b" " * (r.payload_bytes - len(raw))
        assert r.payload_sha256 == hashlib.sha256(back).hexdigest() and r.tail_crc32 == zlib.crc32(back[-16:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert len(r.pair_times) == len(r.pair_hashes) and list(r.pair_times) == sorted(r.pair_times)
    assert got[7][1:] == got[8][1:]
    assert media.with_media(documents(spark, [])).collect() == []


def test_peaks_do_not_depend_on_chunks(monkeypatch):
    x = np.frombuffer(random.Random(1).randbytes(40_000), np.uint8)
    whole = media.peaks(x)
    monkeypatch.setattr(media, "_CHUNK", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, media.peaks(x)))
    t, f = np.array([0, 0, 1, 2, 4]), np.array([5, 9, 7, 3, 8])
    pairs = [(t[i], (f[i] << 14) | (f[j] << 4) | (t[j] - t[i])) for i in range(5) for j in range(5) if 0 < t[j] - t[i] <= media.REACH]
    assert sorted(pairs) == list(zip(*(a.tolist() for a in media.pair_hashes(t, f))))


def plain_license(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in places}))


LICENSED = [
    *ODD, "CC BY. cc-by CC  BY all rights reserved", "GNU General Public License, version 3", "acc by cc byte", "cc by cc by", "Relesed under the MIT Licence.", "Licensed under the Apache License, Version 2.0", "All\nRights\x00Reserved", "cc éby cc by",
    "lorem " * 2000 + "Licensd under the Apache Licence Version 2.0 " + "ipsum " * 2000, "licensed under the apache license version 2 0 " * 40,
]


def test_licenses(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, LICENSED)).collect()}
    for i, t in enumerate(LICENSED):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_license(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit" in got[len(ODD) + 4].labels and "apache-2.0" in got[len(ODD) + 5].labels
    late = got[len(ODD) + 8]
    assert [(s.label, s.first_word, s.last_word) for s in late.spans] == [("apache-2.0", 2000, 2007)]
    assert len(got[len(ODD) + 9].spans) == 40
    assert licenses.scan_licenses(documents(spark, [])).collect() == []


def test_every_bounded_edit_is_found():
    rng = random.Random(3)
    for notice in licenses.NOTICES:
        for _ in range(20):
            chars = list(notice.text)
            for _ in range(rng.randint(0, notice.edits)):
                at = rng.randrange(1, len(chars) - 1)
                kind = rng.randrange(3)
                if kind == 0:
                    chars[at] = rng.choice("qxz")
                elif kind == 1:
                    del chars[at]
                else:
                    chars.insert(at, rng.choice("qxz"))
            found = licenses.scan("foo bar " + "".join(chars) + " baz")[7]
            assert notice.label in {s["label"] for s in found}, ("".join(chars), notice)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First  block
goes on.<br><p>Second&nbsp;block &lt;here&gt;.</p><aside>side</aside><p>Ok.</p><section class="comments"><p>Nice!</p></section></article>
<div id="cookie-notice">We use</div><form><input><label>Mail</label></form><footer>&copy; x &am"""


def test_main_text(spark):
    assert main_text.main_text(PAGE) == "Head & line\nFirst block goes on.\nSecond block <here>.\nOk."
    plain = "<body><div class='menu'><a>x</a><a>y</a></div><div>" + "".join(f"<p>{'Long words of content here. ' * 8}{i}</p>" for i in range(5)) + "</div><div><a>a</a> <a>b</a></div></body>"
    assert main_text.main_text(plain).count("\n") == 4
    pages = [PAGE, None, "", "   ", "<p>only", "plain", "<" * 50, PAGE]
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = main_text.extract_main_text(df).orderBy("page_id").collect()
    assert [r.text for r in got] == [main_text.main_text(h) for h in pages] and all(r.n_chars == len(r.text) for r in got)
    assert got[4].text == "only" and got[1].text == "" and got[0].text == got[7].text
    assert main_text.extract_main_text(df.where("page_id < 0")).collect() == []


def test_feeding_in_pieces_gives_the_same(monkeypatch):
    whole = main_text.main_text(PAGE)
    monkeypatch.setattr(main_text, "CHUNK", 7)
    assert main_text.main_text(PAGE) == whole


def test_main_text_is_chosen_by_ratios_beside_articles():
    cards = "".join(f"<article><a href='/{i}'><b>Card</b> <i>{i}</i></a></article>" for i in range(4))
    body = "".join(f"<p>{'Long words of content here. ' * 8}{i}</p>" for i in range(5))
    got = main_text.main_text(f"<body>{cards}<div>{body}</div>{cards}</body>")
    assert got.count("Long words") == 40 and "Card" not in got


def test_short_payloads_have_peak_pairs():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(n)) for n in (5, 40, 150, 192, 300, 500, 1000) for _ in range(20)]
    rows = [media.describe(t) for t in texts]
    assert all(len(r[7]) for r in rows)
    assert len({r[6] for r, t in zip(rows, texts) if len(t) >= 150}) == 100
    assert len(media.describe("")[7]) == 0


def test_marks_leave_main_text_alone():
    body = "".join(f"<p>{'Long words of content here. ' * 8}{i}</p>" for i in range(4))
    for tag in ("main class='with-sidebar'", "div class='layout sidebar-right'", "article class='post share'", "div class='notice'"):
        got = main_text.main_text(f"<body><nav>x</nav><{tag}><div class='article-header'><h1>Title</h1></div>{body}<div class='share-buttons'>Tell</div></{tag.split()[0]}></body>")
        assert got.count("Long words") == 32 and ("Title" in got or tag[:3] == "div") and "Tell" not in got, tag
    assert "x + y" in main_text.main_text(f"<article>{body}<p><math>x + y</math></p></article>")
    between = main_text.main_text(f"<div>{body}</div><div><p>Short.</p></div><div><a>Menu</a></div><div>{body}</div>")
    assert "Short." in between and "Menu" not in between
    assert "Short." in main_text.main_text(f"<div>{body}</div><div><p>Short.</p></div><div>{body}</div>")


def test_a_byline_is_part_of_the_article():
    body = "".join(f"<p>{'Long words of content here. ' * 8}{i}</p>" for i in range(4))
    got = main_text.main_text(f"<body><nav>x</nav><article><h1>Title</h1><p class='byline'>By A. Writer</p>{body}<div class='share'>Tell</div></article></body>")
    assert got.splitlines()[:2] == ["Title", "By A. Writer"] and "Tell" not in got


def plain_selection(lines):
    """The selection of regions, written with loops: lines are (text, tags, region, characters in links)."""
    ratios = [len(t) / (1 + n) for t, n, _, _ in lines]
    at = lambda i: ratios[min(max(i, 0), len(ratios) - 1)]
    kernel = {d: math.exp(-d * d / 2) for d in range(-3, 4)}
    smooth = [sum(w * at(i + d) for d, w in kernel.items()) / sum(kernel.values()) for i in range(len(ratios))]
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    regions = {lines[i][2] for i in range(len(lines)) if smooth[i] >= spread and ratios[i] >= spread / 2}
    if not regions:
        regions = {lines[max(range(len(lines)), key=lambda i: (smooth[i], -i))][2]}
    out, last = [], None
    for i, (text, _, region, links) in enumerate(lines):
        following = next((j for j in range(i, len(lines)) if lines[j][2] in regions), None)
        if region in regions:
            out.append(text)
            last = i
        elif last is not None and following is not None and following - last <= 4 and 2 * links <= len(text):
            out.append(text)
    return "\n".join(out)


def test_selection_equals_a_plain_version():
    rng = random.Random(11)
    differ = 0
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 9)):
            inner = "".join(f"<{t}>{'word ' * rng.choice([1, 2, 4, 30, 60])}{'<b>x</b>' * rng.choice([0, 0, 3])}</{t}>" for t in rng.choices(["p", "p", "li", "a"], k=rng.randint(1, 4)))
            tag = rng.choice(["div", "section", "div", "article"])
            parts.append(f"<{tag}>{inner}</{tag}>")
        html = f"<body>{''.join(parts)}</body>"
        parser = main_text.Lines()
        parser.feed(html)
        parser.close()
        parser.flush()
        want = plain_selection(parser.lines())
        assert main_text.main_text(html) == want
        differ += want != "\n".join(x[0] for x in parser.lines())
    # The ratios leave something out of many of these pages.
    assert differ > 100


def test_empty_tables_give_no_rows(spark):
    docs = documents(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = langid.fit(docs)
    for df in (main_text.extract_main_text(pages), media.with_media(docs), licenses.scan_licenses(docs), langid.identify(docs, model), toxicity.score_toxicity(docs, toxicity.fit(docs, labels))):
        assert df.collect() == [] and df.columns


def test_neighbouring_edited_notices_are_all_found():
    notice = next(i for i, n in enumerate(licenses.NOTICES) if n.edits >= 2)
    text = licenses.NOTICES[notice].text
    once, twice = text[:3] + "q" + text[4:], text[:3] + "q" + text[4:-3] + "q" + text[-2:]
    found = [x for x in licenses.find_notices(f" {once} {twice} {text} ", licenses.NOTICES) if x[0] == notice]
    assert [x[3] for x in found] == [1, 2, 0]


def distance(a, b):
    """Levenshtein distance by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spans_against_every_run_of_words():
    rng = random.Random(12)
    short = tuple(n for n in licenses.NOTICES if len(n.text) < 50)
    for _ in range(25):
        words = []
        for _ in range(3):
            words += [rng.choice(["lorem", "ipsum", "the", "license", "public"]) for _ in range(rng.randint(0, 3))]
            chars = list(rng.choice(short).text)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(1, len(chars) - 1)
                chars[at : at + rng.randint(0, 1)] = rng.choice(["q", "", "xz"])
            words += "".join(chars).split()
        spans = licenses.scan(" ".join(words))[7]
        for notice in short:
            near = {}
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + 12) + 1):
                    run = " ".join(words[a:b])
                    if abs(len(run) - len(notice.text)) <= notice.edits and (d := distance(run, notice.text)) <= notice.edits:
                        near[(a, b - 1)] = d
            own = [(s["first_word"], s["last_word"], s["edits"]) for s in spans if s["label"] == notice.label]
            # Each reported span is one of the label's runs; each run of the notice meets a reported span.
            for a, b in near:
                assert any(f <= b and a <= n for f, n, _ in own), (words, notice, near, own)
            if sum(n.label == notice.label for n in licenses.NOTICES) == 1:
                assert all((f, n) in near and e >= near[(f, n)] for f, n, e in own), (words, notice, near, own)


def test_many_license_places_take_time_in_proportion():
    times = []
    for n in (20_000, 160_000):
        text = "cc by " * n
        began = time.perf_counter()
        got = licenses.scan(text)
        times.append(time.perf_counter() - began)
        assert got[:4] == (2 * n, n, 0, 2 * n - 2)
    assert times[1] < 30 * times[0] + 0.5


def test_peaks_against_a_plain_transform():
    rng = random.Random(2)
    x = np.array([rng.choice(b"the quick brown fox ") for _ in range(media.BLOCK * 2)], np.uint8)
    signal = [0.0] * (media.FRAME - media.HOP) + [float(v) - 128 for v in x] + [0.0] * media.FRAME * 2
    want = []
    n = -(-(len(x) + 2 * (media.FRAME - media.HOP) - media.FRAME) // media.HOP) + 1
    for t in range(n):
        frame = signal[t * media.HOP : t * media.HOP + media.FRAME]
        mean = sum(frame) / media.FRAME
        frame = [(v - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1))) for i, v in enumerate(frame)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / media.FRAME) for i, v in enumerate(frame))) for k in range(media.FRAME // 2 + 1)]
        best = [max(range(a, b), key=lambda k: power[k]) for a, b in zip(media.BANDS, media.BANDS[1:])]
        top = max(power[k] for k in best)
        want += [(t, k) for k in best if power[k] > 2 * sum(power) / len(power) or power[k] == top > 0]
    assert list(zip(*(v.tolist() for v in media.peaks(x)))) == want


def test_smoothing_decides(monkeypatch):
    """On pages with and without article elements the smoothed ratios choose the text."""
    body = "".join(f"<p>{'Long words of content here. ' * 6}{i}</p>" for i in range(4))
    menu = "".join(f"<li><a href='/{i}'><b>Link</b> <i>{i}</i></a></li>" for i in range(6))
    made = [f"<body><div><ul>{menu}</ul></div><{tag}>{body}</{tag}><div><ul>{menu}</ul></div></body>" for tag in ("div", "article", "section")]
    made.append(f"<body><article>{menu}</article><div>{body}</div></body>")
    real = [main_text.main_text(h) for h in made]
    assert all(t.count("Long words") == 24 and "Link" not in t for t in real)
    monkeypatch.setattr(main_text, "smoothed", lambda ratios, sigma=1.0: -np.arange(len(ratios), dtype=float))
    assert all(a != b for a, b in zip(real, (main_text.main_text(h) for h in made)))


def test_smoothing_is_a_gaussian():
    x = np.random.default_rng(3).random(20)
    got = main_text.smoothed(x)
    for i in range(20):
        w = {j: math.exp(-((j - i) ** 2) / (2 * main_text.SIGMA**2)) for j in range(i - 3, i + 4)}
        want = sum(v * x[min(max(j, 0), 19)] for j, v in w.items()) / sum(w.values())
        assert math.isclose(got[i], want)
