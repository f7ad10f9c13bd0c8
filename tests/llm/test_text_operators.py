"""Operators on single texts and pages against plain versions, with the awkward rows."""

import html
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from guilloche.llm import html_text, packing, quality_rules, token_files, url_filter, warc
from guilloche.llm.common import new_path
from guilloche.llm.tokenize import encoder, vocabulary

TEXTS = [(1, "The cat sat.\nThe cat sat.\n\nx  y\tz"), (2, None), (3, ""), (4, "a " * 3000), (4, "a " * 3000), (5, "Ünï çödé 中文  \x85 <|endoftext|> ß"), (6, "one two three four five one two three four five"), (None, "no id")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", 7, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, start string")


def test_encoder_equals_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(vocabulary(name))
        texts = [t or "" for _, t in TEXTS] + ["a\nb\n\nc \n d", " lead", "trail ", "x\n", "\nx", "don't\r\nstop  now", "'s 's"]
        assert e.encode(texts) == e._library(texts)


def test_packing_places_every_id_once(spark):
    rows = packing.pack_documents(docs(spark), vocabulary("byte_bpe_50k.json"), size=64, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    for (doc, total), pieces in by_doc.items():
        copies = 2 if doc == 4 else 1
        assert sum(n for _, n in pieces) == total * copies
    assert packing.pack_documents(docs(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_histogram_is_used_up():
    counts = {5: 7, 3: 10, 1: 4, 8: 2, 2: 0}
    used = Counter()
    for n, parts in packing.pack_histogram(counts, 8):
        assert sum(length * many for length, many in parts) <= 8
        for length, many in parts:
            used[length] += n * many
    assert used == {k: v for k, v in counts.items() if v}
    with pytest.raises(ValueError):
        packing.pack_histogram({9: 1}, 8)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, encoding):
    path = new_path(spark, "test-tokens")
    manifest = token_files.write_token_files(docs(spark), path, vocabulary("word_bpe_49k.json"), encoding=encoding, row_group_docs=3)
    rows = token_files.read_token_files(spark, manifest, path).orderBy("start").collect()
    lib = encoder(vocabulary("word_bpe_49k.json"))
    want = [np.frombuffer(x, "<u4").tolist() + [2] for x in lib._library([t or "" for _, t in sorted(TEXTS, key=lambda r: r[0] or 0)])]
    assert [list(r.tokens) for r in rows] == want
    assert [r.start for r in rows] == np.cumsum([0] + [len(x) for x in want[:-1]]).tolist()
    nothing = token_files.write_token_files(docs(spark, []), path, vocabulary("word_bpe_49k.json"))
    assert token_files.with_crc32(token_files.read_token_files(spark, nothing, path)).count() == 0


def plain_statistics(text):
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words by the letter of the contract."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if win[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), again, len(covered)


def plain_judge(rows, labels, allowed=0.05, confidence=0.95):
    """(doc_id, the four base columns, base_failed, kept) by plain loops; exact tails from whole-number binomials."""
    stats = []
    for i, text, lang in rows:
        n, chars, symbols, lines, dup, repeat = plain_statistics(text)
        pct = lambda part, of: min(100, 100 * part // of) if of else 0
        feature = {"symbol_pct": pct(symbols, n), "dup_line_pct": pct(dup, lines), "long_word_pct": pct(max(0, chars - 5 * n), 20 * n)}
        stats.append((i, lang, feature, n < 10 or 100 * repeat > 20 * n, (n, chars, symbols, dup, repeat)))
    truth = {}
    for i, q in labels:
        if i is not None:
            truth[i] = min(q, truth.get(i, q))
    holdout = {i: (lang, f, truth[i]) for i, lang, f, failed, _ in stats if i in truth and not failed}
    strata = {lang for lang, _, q in holdout.values() if q}
    level = (1 - confidence) / (len(strata) * 300 or 1)

    def tail(k, n, p):
        return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))

    cut = {}
    for lang in strata:
        good, left, used = [f for x, f, q in holdout.values() if x == lang and q], allowed, {}
        for _ in range(3):
            bad = [f for x, f, q in holdout.values() if x == lang and not q and not any(f[k] > c for k, c in used.items())]
            options = []
            for name in sorted(set(good[0]) - set(used)):
                safe = [c for c in range(100) if all(left > 0 and tail(sum(f[name] > d for f in good), len(good), left) <= level for d in range(c, 100))]
                if safe and (caught := [f[name] for f in bad if f[name] > safe[0]]):
                    options.append((len(caught), name, min(caught) - 1))
            if options:
                _, name, c = max(options, key=lambda o: o[0])
                used[name] = c
                above = sum(f[name] > c for f in good)
                left -= next(p / 1e6 for p in range(1, 10**6) if tail(above, len(good), p / 1e6) <= level)
        cut[lang] = used
    return [(i, *x, failed, not failed and not any(f[k] > c for k, c in cut.get(lang, {}).items())) for i, lang, f, failed, x in stats]


def test_judge_equals_plain_version(spark):
    r = random.Random(5)
    words = [w for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split() for _ in range(3)] + [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(700):
        t = " ".join(r.choices(words, k=r.randrange(5, 40)))
        flaw = r.random()
        if flaw < 0.1:
            t += " #" * r.randrange(1, 25)
        elif flaw < 0.2:
            t += "\nline one" * r.randrange(2, 9)
        elif flaw < 0.25:
            t += " " + "z" * 300
        rows.append((k, t, r.choice(["en", "en", "en", None])))
        if r.random() < 0.9:
            labels.append((k, int(r.random() > (0.9 if 0 < flaw < 0.25 else 0.02))))
    rows += [(900, None, "en"), (901, "", "fr"), (None, "x " * 12, "en"), (902, "\n\n a\x85b \x0b c\n a\x85b \x0b c", "fr")]
    labels += [(3, 0), (None, 1), (4, 1), (4, 1)]
    frame = spark.createDataFrame([(i, t, x, "clash") for i, t, x in rows], "doc_id long, text string, lang string, feature string")
    got = quality_rules.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    plain = plain_judge(rows, labels)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((tuple(x[c] for c in columns) for x in got), key=str) == sorted(plain, key=str)
    assert 0 < sum(not x[6] and not x[7] for x in plain) < 200


def test_statistics_of_odd_texts(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(1, 7)], "doc_id long, quality int")
    for r in quality_rules.judge(docs(spark), labels).collect():
        n, chars, symbols, _, dup, repeat = plain_statistics(next(t for i, t in TEXTS if i == r.doc_id))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (r.base_failed and r.kept)
    assert quality_rules.judge(docs(spark, []), labels).count() == 0
    assert quality_rules.judge(docs(spark), labels.where("false")).where(F.col("kept") == F.col("base_failed")).count() == 0


def test_lowest_safe_cutoff():
    values = [0] * 101
    values[0], values[10], values[90] = 4000, 100, 40
    level = quality_rules.error_level(1, 0.95)
    assert quality_rules.lowest_safe(values, 0.05, level) == 0  # 140 of 4140 above it: safely below 5 per cent
    assert quality_rules.lowest_safe([20] + [0] * 100, 0.05, level) is None  # too few to say
    assert abs(quality_rules.binomial_at_most(1, 3, 0.5) - 0.5) < 1e-12
    assert quality_rules.binomial_at_most(140, 4140, quality_rules.upper_bound(140, 4140, level)) <= level


def test_promise_holds_for_all_rules_together():
    """Simulated holdouts: the rules of a stratum together reject more good documents than allowed in at most 5 per cent of the runs."""
    rng = np.random.default_rng(3)
    names, allowed, broken, used = list(quality_rules.FEATURES), 0.05, 0, 0
    share = {n: s for n, s in zip(names, (0.018, 0.012, 0.02))}  # of good documents with a large value, independent
    for _ in range(150):
        draw = lambda n, of: {f: np.where(rng.random(n) < of[f], rng.integers(30, 60, n), rng.integers(0, 20, n)) for f in names}  # noqa: B023, E731
        good, bad = draw(3000, share), draw(300, dict.fromkeys(names, 0.3))
        cut, left, level = {}, allowed, quality_rules.error_level(1, 0.95)
        for _ in names:
            open_ = np.ones(300, bool)
            for f, c in cut.items():
                open_ &= bad[f] <= c
            counts = lambda x, keep: {f: np.bincount(x[f][keep], minlength=101).tolist() for f in names}  # noqa: B023, E731
            if rule := quality_rules.next_rule(counts(good, slice(None)), counts(bad, open_), [f for f in names if f not in cut], left, level):
                cut[rule[0]] = rule[1]
                left -= rule[2]
        above = lambda f, c: share[f] * max(0, 59 - max(c, 29)) / 30 + (1 - share[f]) * max(0, 19 - c) / 20  # noqa: B023, E731
        kept = np.prod([1 - above(f, c) for f, c in cut.items()])
        broken += 1 - kept > allowed
        used += len(cut)
    assert broken <= 0.05 * 150 and used > 150


def test_rules_share_the_allowed_share(spark):
    plain = lambda k: " ".join(f"{'abcde'[i % 5]}{k}{i}" for i in range(20))
    flaws = {"symbol": lambda t: t + " # # #", "line": lambda t: t + "\nq\nq\nq", "long": lambda t: t + " " + "z" * 80}
    rows, labels = [], []
    for k in range(6000):
        flaw = list(flaws)[k % 3] if k < 180 else None  # 1 per cent of the good documents for each rule
        rows.append((k, flaws[flaw](plain(k)) if flaw else plain(k)))
        labels.append((k, 1))
    # Of the flaws only symbols tell bad documents from good ones.
    rows += [(10_000 + k, plain(k) + " #" * 12) for k in range(50)]
    labels += [(10_000 + k, 0) for k in range(50)]
    got = quality_rules.judge(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept for r in got if r.doc_id < 10_000) and not any(r.kept for r in got if r.doc_id >= 10_000)


def test_main_text_of_pages(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Head &amp; line</h1><p>First&nbsp;block\n of <b>text</b>.<p>Second.</article><div id=comments>Nice post</div><aside>Side</aside><form>Mail</form><footer>&copy; us</footer>"
    )
    plain = "<div><a>Home</a> <a>News</a></div><div>The quick brown fox jumps over the lazy dog and it is of no use to the cat.</div><div>Short one.</div><div>And so the dog was in the house with the cat and that is the end of it.</div>"
    rows = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", plain, 1), (5, "u", "<p", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    assert got[1] == "Head & line First block of text. Second."
    assert got[2] == got[3] == got[5] == ""
    assert got[4] == " ".join(html.unescape(x) for x in re.findall(r"<div>([^<]+)</div>", plain))


def test_attributes_inline_adverts_and_other_languages():
    body = "The quick brown fox jumps over the lazy dog and it is of no use to the cat."
    for attrs in ('data-state="hidden"', 'title="the hidden truth"', 'itemid="share-1"', "data-id=share", 'title="id=menu"'):
        assert html_text.main_text(f"<div {attrs}><p>{body}</p></div>") == body, attrs
    for attrs in ("hidden", 'id="menu"', "class='x ad'", "CLASS=ad", 'data-x="1" hidden', 'aria-hidden="true"', 'style="display: none"'):
        assert html_text.main_text(f"<div {attrs}><p>{body}</p></div>") == "", attrs
    assert html_text.main_text(f"<p>{body} <span class=ad>Buy now</span></p><p>{body}<b class=ad>Buy</p>") == f"{body} {body}"
    finnish = "Nopea ruskea kettu hyppää laiskan koiran yli eikä siitä ole kissalle mitään hyötyä tänään."
    chinese = "敏捷的棕色狐狸跳过了懒惰的狗然后它慢慢地走回森林里面去寻找它的朋友们一起玩耍。"
    for text in (finnish, chinese):
        assert html_text.main_text(f"<div><a>{text}</a></div><div>{text}</div>") == text


LONG = "The quick brown fox jumps over the lazy dog and it is of no use to the cat."
PLUS = "And so the dog was in the house with the cat and that is the end of it."


@pytest.mark.parametrize(
    "page, want",
    [
        # An article element is evidence, not a gate: teasers and second halves.
        (f"<article class='teaser'><p>Card.</p></article><div id='content'><p>{LONG}</p><p>{PLUS}</p></div>", f"{LONG} {PLUS}"),
        (f"<article><p>{LONG}</p></article><div><p>{PLUS}</p></div><footer>Us</footer>", f"{LONG} {PLUS}"),
        (f"<article><p>{LONG}</p><article class=comment><p>{PLUS}</p></article></article>", LONG),
        (f"<article><p>{LONG}</p><p>x1 x2 x3 x4 x5 x6 x7 x8 x9 y1 y2 y3 y4</p><p>Bye.</p></article><div class=ad>{PLUS}</div>", f"{LONG} x1 x2 x3 x4 x5 x6 x7 x8 x9 y1 y2 y3 y4 Bye."),
        # Pages with nothing but short blocks.
        ("<nav><a href=/>Home</a></nav><p>Short text.</p><footer>Us</footer>", "Short text."),
        ("<p>One short paragraph.</p>", "One short paragraph."),
        ("<ul><li><a href=/>Home</a></ul>", ""),
        # Names.
        (f"<div class='share-of-market'><p>{LONG}</p></div><div class='share'><p>Tell friends</p></div>", LONG),
        (f"<div class='layout with-sidebar'><p>{LONG}</p></div><div class='left-sidebar'>{PLUS}</div><div id=post-comments>{PLUS}</div>", LONG),
        (f"<div role=navigation>{PLUS}</div><div style='display:none'>{PLUS}</div><p>{LONG}", LONG),
        (f"<div class='site-header'><p>{PLUS}</p></div><div id=header>{PLUS}</div><div class=post><div class=post-header><h1>Head</h1></div><p>{LONG}</p></div>", f"Head {LONG}"),
        (f"<div class='legal-notice'>{PLUS}</div><div class='top-banner'>{PLUS}</div><div id=alerts>{PLUS}</div><p>{LONG}</p><article><div class=header><p>{LONG}</p></div></article>", f"{LONG} {LONG}"),
        # Unclosed and misplaced tags.
        (f"<noscript>Turn it on<p>{LONG}</p>", f"Turn it on {LONG}"),
        (f"<title>T<p>{LONG}</p>", f"T {LONG}"),
        (f"<textarea>T<p>{LONG}</p>", f"T {LONG}"),
        (f"<nav><a href=/>Home</a><main><p>{LONG}</p></main>", LONG),
        (f"<div class=ad/><p>Buy</p></div><p>{LONG}</p>", LONG),
        (f"<a href=/x/>Link</a><p>{LONG}</p>", LONG),
        (f"<aside><b><b><b><b><b><b>Deep</aside><p>{LONG}</p>", LONG),
        (f"<div><p>{LONG}<table><tr><td>{PLUS}</div>", f"{LONG} {PLUS}"),
        (f"<b><div></b>{LONG}</div><a><div></a>{PLUS}</div>", f"{LONG} {PLUS}"),
        (f"<p>1 < 2 and 3 <4</p><p>{LONG}</p><script>if (a</b) x", f"1 < 2 and 3 <4 {LONG}"),
        (f"<article><h2><a href=/>Head</a></h2><p>{LONG}</p><p><a href=/>All of it a link</a></p></article>", f"Head {LONG}"),
        (f"<p>{LONG}</p><!-- open {PLUS}", LONG),
    ],
)
def test_page_shapes(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("name", "teaser banner subscribe-content alert promotion social".split())
def test_prose_stays_whatever_its_paragraph_is_named(name):
    assert html_text.main_text(f"<article><p>{LONG}</p><p class={name}>{PLUS}</p><p>{LONG}</p></article>") == f"{LONG} {PLUS} {LONG}"


def test_sources_of_an_article_stay():
    assert html_text.main_text(f"<article><p>{LONG}</p><ul><li><a href=/1>First source of the study</a></li><li><a href=/2>Second one</a></li></ul></article>") == f"{LONG} First source of the study Second one"


@pytest.mark.parametrize("name", "commentlist comment-thread disqus_thread discussion reactions user-reviews reader-opinions commentcontent x1".split())
@pytest.mark.parametrize("item", ["<li class=x><b>Ann Smith</b> <span>3 May 2024</span><p>{}</p><a href=#r>Reply</a></li>", "<div class='x y'><p>Ann, <time>today</time></p><p>{}</p><button>Answer</button></div>"])
def test_comments_are_known_by_their_structure(name, item):
    thread = "".join(item.format(t) for t in (PLUS, "Nice one.", PLUS))
    assert html_text.main_text(f"<article><p>{LONG}</p><p>{LONG}</p><div class={name}><div>{thread}</div></div></article>") == f"{LONG} {LONG}"


@pytest.mark.parametrize("name", "notice--warning cookieconsent cookie-law-info-bar adsbygoogle sponsoredcontent related-posts newsletter-form login-form legal copyright most-read x1".split())
def test_named_boxes_beside_the_article_go(name):
    for main in ("<article>{}</article>", "<div class=post>{}</div>"):
        text = main.format(f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>")
        assert html_text.main_text(f"<div id=root><div class={name}><p>{PLUS}</p></div>{text}<div class={name}>{PLUS}</div></div>") == f"Head {LONG} {LONG}"


def test_one_box_with_all_of_the_prose_outvotes_its_name():
    assert html_text.main_text(f"<div class=modal><p>{LONG}</p><p>{PLUS}</p><p>{LONG}</p></div>") == f"{LONG} {PLUS} {LONG}"
    assert html_text.main_text(f"<div class=ad>{LONG}</div>" * 4) == ""


def test_densities_decide_most_blocks(spark, data):
    """On the given pages: without densities a third of the labels would be others, and short blocks inherit theirs."""
    total = changed = open_ = 0
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        found, comments, around = html_text.blocks_of(r.html or "")
        dense = [html_text.density(b, True) for b in found]
        labels = html_text.labels_of(found, comments, around, dense)
        total += len(found)
        changed += sum(x != y for x, y in zip(labels, html_text.labels_of(found, comments, around, [None] * len(found))))
        open_ += labels.count(None)
    assert changed > 0.25 * total and open_ > 0.1 * total


def test_random_pages_equal_their_plan():
    """Well-formed pages from a plan of blocks: the text is what the plan puts into main blocks, whatever surrounds it."""
    r = random.Random(12)
    text = lambda n: " ".join(r.choices("the of and to in a is that it was for on with as by at from dog cat house fox tree river".split(), k=n))
    box = ["<nav>{}</nav>", "<div class='ad'>{}</div>", "<aside>{}</aside>", "<footer>{}</footer>", "<div id='cookie-notice'>{}</div>", "<form>{}</form>", "<section class='comments'>{}</section>", "<div hidden>{}</div>", "<header>{}</header>"]
    for _ in range(300):
        page, want = "", []
        for _ in range(r.randrange(1, 12)):
            t = text(r.randrange(14, 40))
            if r.random() < 0.5:
                page += r.choice(box).format(r.choice(["<p>{}</p>", "<ul><li>{}</li></ul>", "{}"]).format(t))
            else:
                want.append(t)
                inner = t.replace(" fox ", " <b>fox</b>  ", 1).replace(" dog ", "\n<a href='/'>dog</a>&nbsp;", 1)
                page += r.choice(["<p>{}</p>", "<div><div>{}</div></div>", "<blockquote><p>{}</p></blockquote>", "<article><p>{}</p></article>", "<table><tr><td>{}</td></tr></table>", "<h2></h2>{}<br>"]).format(inner)
        assert html_text.main_text(f"<html><head><title>{text(20)}</title></head><body>{page}</body></html>") == " ".join(want), page


def test_hostile_nesting_takes_linear_time():
    spent = {}
    for part in ("<div>", "<b><p>x", "<li>", "<table><td>", "<noscript>", "<a><div></a>", "<div></span></p>"):
        for k in (10_000, 80_000):
            start = time.process_time()
            html_text.main_text(part * k)
            spent[k] = spent.get(k, 0) + time.process_time() - start
    assert spent[80_000] < 24 * spent[10_000]


def test_warc_round_trip_and_damage(spark):
    long = "é" * 600
    rows = spark.createDataFrame([(1, "http://a/", long, 0), (2, "http://b/", long, 0), (3, None, None, 0), (4, "x", "short", 0), (5, "x", "short", 0), (None, "y", long, 0)], "page_id long, url string, html string, payload int")
    path = new_path(spark, "test-warc")
    manifest = warc.write_archives(rows, path, archive_bytes=500)
    got = {r.page_id: r for r in warc.read_archives(manifest, path).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[2].payload.decode()) == ("revisit", 2, "response", long)
    assert got[3].payload == b"" and got[4].record_type == got[5].record_type == "response" and got[None].refers_to == 2
    assert {r.payload_bytes for r in got.values()} == {1200, 0, 5}
    data = next(warc.members(__import__("io").BytesIO(warc.record(9, "u", b"payload", None, "2024-01-01T00:00:00Z"))))
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError):
        list(warc.members(__import__("io").BytesIO(warc.record(9, "u", b"payload", None, "d")[:-5])))
    assert warc.read_archives(warc.write_archives(rows.where("false"), path), path).count() == 0


def test_url_rules_and_aliases(spark):
    rules = spark.createDataFrame([("block", "bad.com/"), ("allow", "bad.com/ok/"), ("block", "x.org/a"), ("allow", "y.org/"), (None, "z.org/")], "action string, rule string")
    urls = ["http://bad.com/1", "http://s.BAD.com/ok/2?q", "http://notbad.com/", "http://alias.net/p", "http://far.net/q", "http://x.org/a", "http://both.net/", None, "no-scheme", "http://bad.com"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    edges = spark.createDataFrame([("http://alias.net/p", "http://bad.com/1"), ("http://far.net/q", "https://www.alias.net/p/"), ("http://both.net/", "http://x.org/a"), ("http://both.net/", "http://y.org/"), (None, "http://x.org/a")], "src string, dst string")
    got = {r.page_id: r for r in url_filter.judge(pages, edges, rules).collect()}
    assert [got[i].verdict for i in range(10)] == ["block", "allow", "allow", "block", "block", "block", "allow", "allow", "allow", "allow"]
    assert (got[1].host, got[1].path, got[1].rule) == ("s.bad.com", "/ok/2", "bad.com/ok/") and got[8].host == got[7].path == ""


def test_links_of_pages(spark):
    at = "http://a.com/x/y/page.html?q=1"
    cases = {
        "<link rel=canonical href='http://b.com/'>": ["http://b.com/"],
        '<LINK href="../z" REL="alternate canonical">': ["http://a.com/x/z"],
        "<link rel=canonical href=next.html>": ["http://a.com/x/y/next.html"],
        "<link rel=canonical href='?id=3&amp;k=4'>": ["http://a.com/x/y/page.html?id=3&k=4"],
        "<base href='/deep/er/'><link rel='canonical' href='p'>": ["http://a.com/deep/er/p"],
        "<meta http-equiv=refresh content='0; url=//c.org/q'>": ["http://c.org/q"],
        """<meta http-equiv="Refresh" content="5;URL='/r'">""": ["http://a.com/r"],
        "<meta http-equiv=refresh content=30>": [],
        "<link rel=stylesheet href=canonical.css><link rel=canonical><link rel=canonical href='mailto:x'><link rel=canonical href='http://[bad'>": [],
    }
    for page, want in cases.items():
        assert url_filter.links_of(at, page) == want, page
    rows = [(i, at, page) for i, page in enumerate(cases)] + [(20, None, "<link rel=canonical href=/x>"), (21, at, None)]
    got = sorted((r.src, r.dst) for r in url_filter.page_edges(spark.createDataFrame(rows, "page_id int, url string, html string")).collect())
    assert got == sorted((at, t) for want in cases.values() for t in want)


def test_links_carry_verdicts(spark):
    """A page's canonical link joins it to a blocked url, a form to both, an allowed alias frees another group."""
    rules = spark.createDataFrame([("block", "bad.com/"), ("allow", "good.org/")], "action string, rule string")
    rows = [
        (1, "http://one.net/a", "<link rel=canonical href='http://bad.com/p'>"),
        (2, "https://www.one.net/a/", ""),
        (3, "http://two.net/", "<meta http-equiv=refresh content='0;url=http://bad.com/q'>"),
        (4, "http://good.org/z", "<link rel=canonical href='http://two.net/'>"),
        (5, "http://three.net/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: (r.verdict, r.alias_group) for r in url_filter.judge(pages, url_filter.page_edges(pages), rules).collect()}
    assert {k: v for k, (v, _) in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    assert got[1][1] == got[2][1] and got[3][1] == got[4][1] != got[5][1]
