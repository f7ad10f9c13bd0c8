"""Operators over whole collections against brute force, with the awkward rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from guilloche.llm import common, decontaminate, line_dedup, near_dup, quality_model
from guilloche.llm.graph import connected_components
from guilloche.llm.tokenize import encoder, vocabulary
from test_text_operators import plain_judge

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], SCHEMA)


def family(seed=3, base=80, copies=40):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, n = [], 0
    for _ in range(6):
        words = r.choices(vocabulary, k=base)
        for _ in range(copies):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4, 8])):
                w[r.randrange(base)] = r.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "two words"), (n + 3, "two words"), (n + 3, "two words"), (None, "two words"), (n + 4, "WORD " * 5000)]


def brute(rows, k, percent):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "")) if x]
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(a), find(i)) for i, a in sets}


def test_near_duplicates_equal_brute_force(spark):
    rows = family()
    want = brute(rows, 4, 80)
    got = near_dup.components(make(spark, rows), shingle=4, percent=80).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert not r.kept and r.component_id == want[max(i for i, t in rows if i is not None and t == "two words")][1]
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert near_dup.components(make(spark, [])).count() == 0


def test_match_threshold_follows_the_similarity(spark):
    """Chains of texts that drift apart around half their shingles."""
    r = random.Random(9)
    rows, n = [], 0
    for _ in range(8):
        words = [f"v{r.randrange(3000)}" for _ in range(60)]
        for _ in range(12):
            rows.append((n, " ".join(words)))
            n += 1
            for _ in range(r.choice([2, 4, 6])):
                words[r.randrange(60)] = f"v{r.randrange(3000)}"
    want = brute(rows, 4, 50)
    got = near_dup.components(make(spark, rows), shingle=4, percent=50).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want and len({c for _, c in want.values()}) > 8
    assert near_dup.least_matches(80) > near_dup.least_matches(50) > 0


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in root}


@pytest.mark.parametrize("broadcast_rows", [common.BROADCAST_ROWS, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, broadcast_rows):
    r = random.Random(2)
    v = [f"t{k}" for k in range(30)]
    items = [(k, " ".join(r.choices(v, k=n))) for k, n in enumerate([25, 14, 10, 9, 3, 2, 1, 0])] + [(8, None), (9, "t1 t2, t3")]
    texts = [" ".join(r.choices(v, k=60)) for _ in range(20)]
    texts += [" ".join(r.choices(v, k=9_000))]  # very long
    texts += [f"{' '.join(r.choices(v, k=5))} {items[k][1].upper().replace(' ', '; ')} tail" for k in range(7)] + [None, "", "...", texts[0]]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, items[0][1])]
    monkeypatch.setattr(decontaminate, "small", lambda df: common.small(df, broadcast_rows))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast_rows else -1)
    plans = {}

    def stage(df, label):
        plans[label] = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return common.stage(df, label)

    monkeypatch.setattr(decontaminate, "stage", stage)
    got = decontaminate.contamination(make(spark, rows), spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")).collect()
    # Broadcast or not, no row for a position carries the words of its document through an exchange.
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plans["rarity"] + plans["places"])
    assert moved and not any(re.search(r"\b_w#|\btext#|\b_win#", m) for m in moved)
    assert broadcast_rows or any("_at#" in m and "_s#" in m for m in moved)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    words = lambda t: [x.lower() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    windows = {(k, tuple(w[i : i + 10])) for k, t in items for w in [words(t)] if w for i in range(max(1, len(w) - 9))}
    want = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for k, win in windows:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found.add(k)
        want.append((i, len(w), len(hit), len(found), bool(hit)))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in got), key=key) == sorted(want, key=key)
    none = decontaminate.contamination(make(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated or n_items > 0").count() == 0 and none.count() == len(rows)


def test_patience_alignment():
    assert line_dedup.patience([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (3, 5)]
    assert line_dedup.patience([5, 5, 1, 5], [5, 1, 5, 5]) == [(0, 0), (3, 3), (2, 1)] or len(line_dedup.patience([5, 5, 1, 5], [5, 1, 5, 5])) >= 2
    assert line_dedup.common_blocks([1, 2, 3], [1, 7, 2, 3], [4, 1, 6, 6], 10) == [(2, 4)]


def test_line_blocks_go_from_later_documents(spark):
    block = "\n".join(" ".join(f"b{k}{j}" for j in range(6)) for k in range(3))
    rows = [(1, f"own one\n{block}\nend"), (2, f"{block}\nshort"), (3, "short\nother text here"), (4, None), (5, ""), (None, block), (7, block), (7, block)]
    got = {}
    for r in line_dedup.deduplicate(make(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: [rows[0][1]], 2: ["short"], 3: [rows[2][1]], 4: [None], 5: [""], None: [block], 7: ["", ""]}
    assert line_dedup.deduplicate(make(spark, [])).count() == 0


def test_repeated_and_swapped_blocks_are_found():
    x, p, q, y, u, v, w = range(1, 8)
    find = lambda a, b: line_dedup.common_blocks(a, b, [12] * len(b), 10)
    assert find([x, p, y], [u, p, v, p, w]) == [(1, 2), (3, 4)]
    assert find([p, x, p, y], [u, p, v]) == [(1, 2)]
    assert find([p, q], [q, u, p]) == [(0, 1), (2, 3)]
    r = random.Random(4)
    for _ in range(400):
        size = [r.randrange(0, 8) for _ in range(6)]
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 14))] for _ in range(2))
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = {k for i in range(len(b)) for j in range(i + 1, len(b) + 1) if tuple(b[i:j]) in runs and sum(size[z] for z in b[i:j]) >= 10 for k in range(i, j)}
        got = {k for i, j in line_dedup.common_blocks(a, b, [size[z] for z in b], 10) for k in range(i, j)}
        assert got <= want and all(size[b[k]] == 0 for k in want - got)


def test_blocks_of_short_lines_go_whoever_held_their_lines_first(spark):
    one, two, three = (" ".join(f"l{k}{j}" for j in range(4)) for k in range(3))
    head, tail = " ".join(f"h{j}" for j in range(12)), "t1 t2 t3"
    rows = [(1, f"{one}\n{two}"), (2, f"{two}\n{three}"), (3, f"{one}\n{two}\n{three}"), (4, f"{one}\n{two}\n{three}"), (5, head), (6, f"{head}\n{tail}"), (7, f"x\n{head}\n{tail}")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(make(spark, rows)).collect()}
    assert got == {**dict(rows), 4: "", 6: tail, 7: "x"}


def plain_lines(rows, min_words=10):
    """Per document, in order, its lines with words that no earlier document holds in a run of ``min_words`` words; None for a null text."""
    held, out = set(), {}
    for i, text in rows:
        if text is None:
            out[i] = None
            continue
        own = [" ".join(x.split()) for x in text.split("\n")]
        size = [len(x.split()) for x in own]
        total = [0]
        for n in size:
            total.append(total[-1] + n)
        # Runs that are as short as they can be stand for all longer ones.
        runs = [(a, b) for a in range(len(own)) for b in [next((b for b in range(a + 1, len(own) + 1) if total[b] - total[a] >= min_words), 0)] if b]
        runs += [(a, b) for b in range(1, len(own) + 1) for a in [next((a for a in range(b - 1, -1, -1) if total[b] - total[a] >= min_words), -1)] if a >= 0]
        gone = {k for a, b in runs if tuple(own[a:b]) in held for k in range(a, b) if size[k]}
        out[i] = [x for k, x in enumerate(text.split("\n")) if size[k] and k not in gone]
        held.update(tuple(own[a:b]) for a, b in runs)
    return out


def test_line_dedup_equals_brute_force(spark):
    """Random documents over few lines: the lines with words that go are those in runs that an earlier document holds."""
    r = random.Random(8)
    lines = [" ".join(f"q{k}n{j}" for j in range(r.choice([1, 3, 4, 6, 11]))) for k in range(14)] + [""]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 12)))) for k in range(150)]
    rows += [(150 + k, "\n".join(lines[i] for i in part)) for k, part in enumerate([(1, 2), (2, 3), (1, 2, 3), (1, 2, 3), (3, 2, 1)])]
    got = {x.doc_id: x.text for x in line_dedup.deduplicate(make(spark, rows), min_words=10).collect()}
    want = plain_lines(rows)
    assert {i: [x for x in t.split("\n") if x] for i, t in got.items()} == want


def test_line_dedup_with_clashing_names(spark):
    names = ["spans", "own", "raw", "id", "text_key", "_id", "_k", "_text", "_key", "row", "n_lines"]
    docs = make(spark, [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k\nmine"), (3, None)])
    got = line_dedup.deduplicate(docs.withColumns({n: F.lit(n) for n in names})).collect()
    assert {r.doc_id: r.text for r in got} == {1: "a b c d e f g h i j k", 2: "mine", 3: None}
    assert all(r[n] == n for r in got for n in names if n != "n_lines") and {r.n_lines for r in got} == {0, 1, 2}


def test_quality_model_holds_out(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_model.score(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("truth")), "doc_id").collect()
    assert sum(r.kept == bool(r.truth) for r in scored) >= 0.95 * len(scored)
    odd = make(spark, [(1, None), (2, ""), (None, "x"), (2, "")]).withColumn("source", F.lit(None).cast("string"))
    assert quality_model.score(odd, labels.where("false")).count() == 4


def plain_sites(rows):
    """(host_posterior, path_posterior, quality_score) of rows (host, path, evidence, label) by plain loops."""
    known = [e if y is None else y for _, _, e, y in rows]
    overall = sum(known) / len(known)

    def weight(groups, prior):
        n = sum(map(len, groups.values()))
        if len(groups) < 2 or n <= len(groups):
            return None
        mean = {g: sum(v) / len(v) for g, v in groups.items()}
        inner = sum((x - mean[g]) ** 2 for g, v in groups.items() for x in v) / (n - len(groups))
        between = sum(len(v) * (mean[g] - prior(g)) ** 2 for g, v in groups.items())
        spread = (between - (len(groups) - 1) * inner) / (n - sum(len(v) ** 2 for v in groups.values()) / n)
        return inner / spread if spread > 0 else None

    hosts, paths = {}, {}
    for (h, p, _, _), y in zip(rows, known):
        hosts.setdefault(h, []).append(y)
        paths.setdefault((h, p), []).append(y)
    wh = weight(hosts, lambda g: overall)
    wp = weight(paths, lambda g: sum(hosts[g[0]]) / len(hosts[g[0]]))
    logit = lambda q: math.log(min(max(q, 0.01), 0.99) / (1 - min(max(q, 0.01), 0.99)))
    out = []
    for (h, p, e, _), y in zip(rows, known):
        pull = lambda v, prior, w: prior if w is None else (sum(v) - y + w * prior) / (len(v) - 1 + w)  # noqa: B023, E731
        a = pull(hosts[h], overall, wh)
        b = pull(paths[h, p], a, wp)
        out.append((a, b, 1 / (1 + math.exp(-(logit(e) + logit(b) - logit(overall))))))
    return out


def test_sites_shrink_and_flip_as_the_plain_version_says(spark):
    r = random.Random(4)
    rows = []
    for host, n, good in [("big-bad", 400, 0.02), ("big-good", 400, 0.97), ("mixed", 300, 0.5), (None, 40, 0.9)] + [(f"small{k}", 1, 0.5) for k in range(30)]:
        for k in range(n):
            y = float(r.random() < good)
            unclear = r.random() < 0.5
            e = r.uniform(0.4, 0.6) if unclear else min(0.99, max(0.01, r.gauss(0.9 if y else 0.1, 0.05)))
            rows.append((host, r.choice(["a", "b", None]), e, y if k % 2 else None))
    schema = "doc_id long, _host string, _path string, evidence double, _known double"
    got = quality_model.with_sites(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], schema), threshold=0.5).orderBy("doc_id").collect()
    want = plain_sites(rows)
    for g, w in zip(got, want):
        assert all(abs(a - b) < 1e-9 for a, b in zip((g.host_posterior, g.path_posterior, g.quality_score), w))
        assert g.kept == (w[2] >= 0.5) or abs(w[2] - 0.5) < 1e-9
    overall = sum(e if y is None else y for _, _, e, y in rows) / len(rows)
    sparse = [g for g, x in zip(got, rows) if str(x[0]).startswith("small")]
    assert all(abs(g.path_posterior - overall) < 1e-9 for g in sparse)  # nothing else is known of their sites
    unclear = lambda host: [g for g, x in zip(got, rows) if x[0] == host and 0.4 < x[2] < 0.6]
    assert not any(g.kept for g in unclear("big-bad")) and all(g.kept for g in unclear("big-good"))


def test_sites_of_chance_say_nothing(spark):
    r = random.Random(7)
    rows = [(i, f"h{i % 5}", f"p{i % 3}", 0.2 + 0.6 * (i // 15 % 2), None) for i in range(600)]
    r.shuffle(rows)
    got = quality_model.with_sites(spark.createDataFrame(rows, "doc_id long, _host string, _path string, evidence double, _known double"), threshold=0.5).collect()
    assert all(abs(g.path_posterior - 0.5) < 1e-9 and abs(g.quality_score - g.evidence) < 1e-9 for g in got)


def test_evidence_reads_the_words(spark):
    """Good and bad documents that only their words tell apart."""
    r = random.Random(2)
    good, bad = (["".join(r.choices("abcdefgh" if k else "mnopqrst", k=5)) for _ in range(200)] for k in (0, 1))
    rows = [(i, " ".join(r.choices(good if i % 2 else bad, k=30))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality_model.score(make(spark, rows), labels).collect()
    assert all(g.kept == bool(g.doc_id % 2) for g in got if g.doc_id >= 200)


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dup", "decontamination", "packing"]
    before = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, before, data)
        assert after.columns == corpus_pipeline.COLUMNS
        assert after.join(docs, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= before.count()
        before = corpus_pipeline.stage(after, name)
    clean = decontaminate.contamination(before, spark.read.parquet(f"{data}/benchmark.parquet"))
    assert clean.where("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert packed.select("doc_id").distinct().count() == before.count()


def test_every_stage_equals_its_plain_version(spark, data):
    """Each stage on its own input: the documents table, longest texts included, with rows without id or text."""
    labels = [tuple(r) for r in spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality").collect()]
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    odd = make(spark, [(10**6, None), (10**6 + 1, ""), (10**6 + 2, items[0]), (10**6 + 3, " ".join(f"z{k}" for k in range(40)))]).drop("rep")
    docs = corpus_pipeline.stage(spark.read.parquet(f"{data}/documents.parquet").unionByName(odd), "documents")
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    before = docs.collect()
    after = corpus_pipeline.stage(steps["quality_rules"](spark, docs, data), "quality")
    kept = {x[0] for x in plain_judge([(r.doc_id, r.text, r.lang) for r in before], labels) if x[-1]}
    assert rows(after) == sorted((r.doc_id, r.text) for r in before if r.doc_id in kept)

    before, docs = rows(after), after
    after = corpus_pipeline.stage(steps["line_dedup"](spark, docs, data), "lines")
    want = plain_lines(before)
    assert {i: [x for x in t.split("\n") if x.split()] for i, t in rows(after)} == {i: x for i, x in want.items() if x}
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text != dict(before)[r.doc_id])

    before, docs = rows(after), after
    after = corpus_pipeline.stage(steps["near_dup"](spark, docs, data), "near")
    assert [i for i, _ in rows(after)] == [i for i, (_, root) in sorted(brute(before, 5, 80).items()) if i == root]

    before, docs = rows(after), after
    after = corpus_pipeline.stage(steps["decontamination"](spark, docs, data), "clean")
    words = lambda t: [x.lower() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    windows = {tuple(w[i : i + 10]) for t in items for w in [words(t)] if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    dirty = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert rows(after) == [(i, t) for i, t in before if not dirty(words(t))] and len(rows(after)) < len(before)

    packed = steps["packing"](spark, after, data).collect()
    lib = encoder(vocabulary("byte_bpe_50k.json")).lib
    ids = {i: [*lib.encode(t, add_special_tokens=False).ids, 1] for i, t in rows(after)}
    sequences, places = {}, {}
    for p in packed:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and len(part) == p.length and zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        places.setdefault(p.doc_id, []).append((p.start, p.length))
    for spans, total in [*((x, None) for x in sequences.values()), *((x, len(ids[i])) for i, x in places.items())]:
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 2048 if total is None else end == total
    # As few sequences as an exhaustive first fit of the same pieces needs, and one more at most.
    free = []
    for n in sorted((p.length for p in packed), reverse=True):
        k = next((k for k, room in enumerate(free) if room >= n), None)
        if k is None:
            free.append(2048 - n)
        else:
            free[k] -= n
    assert places.keys() == ids.keys() and len(sequences) <= len(free) + 1


def test_stages_with_null_and_repeated_ids(spark, data):
    text = lambda k, n=60: " ".join(f"{'abcdefghij'[(i * i + k) % 10]}{k}x{i}" for i in range(n))
    block = "\n".join(text(90 + k, 12) for k in range(2))
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("size(split(text, ' ')) > 15").orderBy("item_id").first().text
    first = lambda name, rows: sorted(((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)[name](spark, make(spark, rows).drop("rep"), data).collect()), key=str)
    order = lambda rows: sorted(rows, key=str)
    far = 10**9
    good, other = text(1), text(2)
    assert first("quality_rules", [(None, good), (None, "short"), (far, other), (far, "short")]) == order([(None, good), (far, other)])
    assert first("decontamination", [(None, good), (None, item), (far, other), (far, item)]) == order([(None, good), (far, other)])
    near = [(7, good), (7, good), (7, other), (None, good), (None, text(3)), (None, text(3)), (9, other), (None, ""), (None, ""), (7, "")]
    assert first("near_dup", near) == order([(7, good), (7, other), (None, text(3)), (None, ""), (7, "")])
    got = first("line_dedup", [(3, f"{good}\n{block}"), (None, f"{other}\n{block}"), (4, f"{block}\n{text(5)}"), (4, f"{block}\n{text(6)}")])
    assert got == order([(3, f"{good}\n{block}"), (None, other), (4, text(5)), (4, text(6))])
    within = first("line_dedup", [(4, f"{block}\n{text(5)}"), (4, f"{block}\n{text(6)}")])
    assert sum(block in t for _, t in within) == 1 and len(within) == 2
