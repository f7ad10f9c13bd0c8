"""Queries and oracle SQL of the token and denomination operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from guilloche.functions.udtf import register
from guilloche.operators import denomination as D
from guilloche.operators import tokens as T
from guilloche.schemas import PALETTE, values_sql

from .fixtures import load, oracle

_REGIONS = [(0, 0.12, 0.32, 0.03, 0.32), (0, 0.78, 1.0, 0.55, 1.0), (1, 0.15, 0.27, 0.03, 0.28), (1, 0.83, 0.96, 0.6, 0.99), (2, 0.17, 0.25, 0.03, 0.28), (2, 0.86, 0.95, 0.6, 0.98), (3, 0.15, 0.3, 0.02, 0.32), (3, 0.82, 0.97, 0.55, 1.0)]
_BOXED = {"w": "CAST(CASE WHEN seq < 2 THEN 260 ELSE 40 + note_id % 50 END AS INT)", "img_w": "1000", "img_h": "650"}
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_REGION = "CASE WHEN note_id % 2 = 0 THEN 'whole' ELSE 'corner' END"


def _tokens(spark, d):
    return load(spark, d, "fx_tokens")


def _boxed(spark, d):
    return _tokens(spark, d).selectExpr("*", *[f"{v} AS {k}" for k, v in _BOXED.items()])


def _variants(spark, d):
    return _tokens(spark, d).selectExpr("note_id", "CASE WHEN y > 300 THEN 'bottom' ELSE 'top' END AS region", "CAST(seq % 2 AS INT) AS variant", "seq", "text", "conf", "x", "y", "h")


def s9(spark, d):
    words = _tokens(spark, d).selectExpr("note_id", "seq", "concat(' ', lower(text), CASE WHEN seq = 5 AND note_id % 3 = 0 THEN '' ELSE ' ' END) AS text", "conf / 100D AS conf", "array(named_struct('x', x, 'y', y), named_struct('x', x + 40, 'y', y), named_struct('x', x + 40, 'y', y + h), named_struct('x', x, 'y', y + h)) AS box")
    return T.ingest_words(words)


def t1(spark, d):
    return T.confusion_maps(_tokens(spark, d))


def t2(spark, d):
    return T.prefixes(_tokens(spark, d))


def t3(spark, d):
    return T.digit_groups(_tokens(spark, d))


def t4(spark, d):
    return T.single_token(_tokens(spark, d))


def t5(spark, d):
    return T.paired_tokens(_tokens(spark, d)).select("note_id", "serial", "conf", "part")


def t6(spark, d):
    return T.two_letter_pairs(_tokens(spark, d))


def t7(spark, d):
    return T.serials_in_text(load(spark, d, "documents"), "doc_id", F.translate("text", _LOWER, _LOWER.upper()))


def t8(spark, d):
    return T.cross_variant(_variants(spark, d))


def t9(spark, d):
    return T.vote(T.candidates(_tokens(spark, d)))


def t10(spark, d):
    return T.independent_vote(_tokens(spark, d))


def t11(spark, d):
    return T.serial_tokens(_tokens(spark, d)).select("note_id", "seq", "text")


def t12(spark, d):
    return T.serial_region(_boxed(spark, d))


def t13(spark, d):
    return T.serial_check(load(spark, d, "fx_notes"), _tokens(spark, d))


def t14(spark, d):
    return T.valid_format(T.vote(T.candidates(_tokens(spark, d)))).select("note_id", "serial", "valid")


def t15(spark, d):
    regions = spark.createDataFrame(_REGIONS, "candidate int, y0 double, y1 double, x0 double, x1 double")
    return T.tune_regions(_boxed(spark, d), load(spark, d, "fx_notes"), regions)


def d1(spark, d):
    return D.candidates(_tokens(spark, d)).select("note_id", "seq", "text", "nth", "denom")


def d1_udtf(spark, d):
    register(spark)
    _tokens(spark, d).select("note_id", "seq", F.expr("replace(upper(trim(text)), ' ', '')").alias("text")).createOrReplaceTempView("denom_tokens")
    return spark.sql("SELECT note_id, seq, text, nth, denom FROM denom_tokens, LATERAL denom_candidates(text)")


def d2(spark, d):
    return D.scores(_tokens(spark, d), load(spark, d, "fx_palette_stats")).select("note_id", "denom", "exact_score", "confused_score")


def d3(spark, d):
    return D.palette_hits(load(spark, d, "fx_palette_stats"))


def d4(spark, d):
    return D.merged(D.scores(_tokens(spark, d), load(spark, d, "fx_palette_stats"))).select("note_id", "denom", "score")


def d5(spark, d):
    stats = load(spark, d, "fx_palette_stats").withColumn("coloured_px", F.col("coloured_px") * 3)
    return D.colour_only(D.merged(D.scores(_tokens(spark, d), stats)), stats).select("note_id", "denom", "score")


def d6(spark, d):
    return D.classify(load(spark, d, "fx_notes"), _tokens(spark, d), load(spark, d, "fx_palette_stats").withColumn("coloured_px", F.col("coloured_px") * 3))


def d7(spark, d):
    tokens = _tokens(spark, d).selectExpr("*", f"{_REGION} AS region", "CAST(400 AS INT) AS region_h")
    return D.classify_regions(load(spark, d, "fx_notes"), tokens, load(spark, d, "fx_palette_stats")).select("note_id", "status", "value")


QUERIES = {
    "s9_ingest_words": s9, "t1_confusion_maps": t1, "t2_prefixes": t2, "t3_digit_groups": t3, "t4_single_token": t4, "t5_paired_tokens": t5, "t6_two_letter_pairs": t6, "t7_serials_in_text": t7,
    "t8_cross_variant": t8, "t9_serial_vote": t9, "t10_independent_vote": t10, "t11_serial_tokens": t11, "t12_serial_region": t12, "t13_serial_check": t13, "t14_serial_format": t14, "t15_tune_regions": t15,
    "d1_denom_candidates": d1, "d1_denom_candidates_udtf": d1_udtf, "d2_denom_scores": d2, "d3_palette_hits": d3, "d4_merged_scores": d4, "d5_colour_only": d5, "d6_classify": d6, "d7_classify_regions": d7,
}


def _dig(c: str) -> str:
    return f"translate({c}, 'OIJSB', '01158')"


def _let(c: str) -> str:
    return f"translate({c}, '0158', 'OISB')"


def _prefix(c: str) -> str:
    mixed = f"{_dig(f'substr({c}, 1, 1)')} || {_let(f'substr({c}, 2, 2)')}"
    return f"CASE WHEN length({c}) <> 3 THEN NULL WHEN regexp_matches({mixed}, '^[0-9][A-Za-z]{{2}}$') THEN {mixed} WHEN regexp_matches({_dig(c)}, '^[0-9]{{3}}$') THEN {_dig(c)} END"


def _digits(c: str) -> str:
    return f"CASE WHEN regexp_matches({_dig(c)}, '^[0-9]{{6,7}}$') THEN {_dig(c)} END"


def _single(text: str) -> str:
    r = "'^([A-Z0-9]{3})(\\*?)([0-9OISBJ]{6,7})'"
    p, s, g = (f"regexp_extract({text}, {r}, {k})" for k in (1, 2, 3))
    return f"SELECT note_id, seq, p || CASE WHEN s = '*' THEN '*' ELSE ' ' END || g AS serial, CAST(conf AS DOUBLE) AS conf FROM (SELECT *, {_prefix(p)} AS p, {s} AS s, {_digits(g)} AS g FROM fx_tokens) WHERE p IS NOT NULL AND g IS NOT NULL"


_PARTS = f"""
tk AS (SELECT *, CASE WHEN regexp_matches(text, '^[A-Z0-9]{{3}}$') THEN {_prefix('text')} END AS pre, {_digits('text')} AS dig FROM fx_tokens),
pairs AS (SELECT p.note_id, d.seq, p.seq AS seq2, p.pre || ' ' || d.dig AS serial, (p.conf + d.conf) / 2 AS conf FROM tk p JOIN tk d ON p.note_id = d.note_id AND p.pre IS NOT NULL AND d.dig IS NOT NULL AND p.seq <> d.seq AND p.x < d.x AND abs(p.y - d.y) <= greatest(d.h, 12)),
ones AS ({_single("replace(text, ' ', '')")}),
raws AS ({_single('text')}),
cand AS (SELECT note_id, 0 AS part, seq, 0 AS seq2, serial, CAST(trunc(conf) AS BIGINT) AS conf FROM ones UNION ALL SELECT note_id, 1, seq, seq2, serial, CAST(trunc(conf) AS BIGINT) FROM pairs UNION ALL SELECT note_id, 2, seq, 0, serial, CAST(trunc(conf) AS BIGINT) FROM raws),
sums AS (SELECT note_id, serial, count(*) AS votes, sum(conf) AS conf_sum, min((part, seq, seq2)) AS o1 FROM cand GROUP BY note_id, serial),
best AS (SELECT note_id, serial, votes, CAST(conf_sum AS BIGINT) AS conf_sum FROM sums QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY votes DESC, conf_sum DESC, o1) = 1)
"""
_LOOKS = "(regexp_matches(t, '^([A-Z0-9]{3})(\\*?)([0-9OISBJ]{6,7})') OR regexp_matches(t, '[A-Z0-9OISB]{3}\\s?[0-9OISB]{6,7}') OR (length(t) >= 6 AND length(regexp_replace(t, '[^0-9]', '', 'g')) >= 5))"
_KNOWN = "('10', '20', '50', '100', '200', '500', '2000')"
_CANDIDATES = f"""
ct AS (SELECT *, replace(upper(trim(text)), ' ', '') AS t FROM fx_tokens),
cf AS (SELECT note_id, seq, conf, h, t, {_dig('t')} AS f FROM ct),
cw AS (SELECT *, list_concat([f], CASE substr(f, 1, 1) WHEN '9' THEN ['5' || substr(f, 2), '2' || substr(f, 2), '1' || substr(f, 2)] WHEN '8' THEN ['5' || substr(f, 2)] WHEN '4' THEN ['1' || substr(f, 2)] WHEN '6' THEN ['5' || substr(f, 2)] ELSE [] END, [substr(f, 2)]) AS ways FROM cf WHERE regexp_matches(f, '^[0-9]+$')),
cx AS (SELECT note_id, seq, conf, h, t, k, ways[k] AS denom FROM cw, unnest(generate_series(1, len(ways))) g(k) WHERE ways[k] IN {_KNOWN} AND list_position(ways, ways[k]) = k),
cn AS (SELECT *, CAST(row_number() OVER (PARTITION BY note_id, seq ORDER BY k) - 1 AS INT) AS nth FROM cx)
"""


def _scored(factor: int, region: bool = False) -> str:
    stats = f"st AS (SELECT note_id, med_hue, med_sat, coloured_px * {factor} AS coloured_px, total_px FROM fx_palette_stats)"
    pal = f"pal(denom, hlo, hhi, slo, shi) AS ({values_sql((d, *b) for d, b in PALETTE.items())})"
    hits = "hits AS (SELECT note_id, denom FROM st JOIN pal ON CASE WHEN coloured_px < 200 THEN denom IN ('500', '10') ELSE med_hue BETWEEN hlo AND hhi AND med_sat BETWEEN slo AND shi END)"
    if region:
        scores = f"""ts AS (SELECT cn.note_id, cn.denom, CASE WHEN nth = 0 AND cn.denom = t THEN conf END AS e, CASE WHEN NOT (nth = 0 AND cn.denom = t) THEN conf END AS c, seq * 10 + nth AS o FROM cn LEFT JOIN hits USING (note_id, denom)
 WHERE conf >= 25 AND h >= 400 * CASE WHEN cn.note_id % 2 = 0 THEN 0.03 ELSE 0.12 END AND ((nth = 0 AND cn.denom = t) OR hits.note_id IS NOT NULL)),
sc AS (SELECT note_id, denom, sum(e) AS e, sum(c) AS c, min(CASE WHEN e IS NOT NULL THEN o END) AS fe, min(CASE WHEN c IS NOT NULL THEN o END) AS fc FROM ts GROUP BY note_id, denom),
mg AS (SELECT note_id, denom, round(coalesce(e, 0)::DOUBLE + coalesce(c, 0)::DOUBLE * 0.7::DOUBLE * 0.5::DOUBLE, 6) AS score, fe IS NULL AS late, coalesce(fe, fc) AS o1 FROM sc)"""
        share = 0
    else:
        scores = """ts AS (SELECT cn.note_id, cn.denom, CASE WHEN nth = 0 AND cn.denom = t THEN conf END AS e, CASE WHEN NOT (nth = 0 AND cn.denom = t) THEN CAST(trunc(conf::DOUBLE * 0.7::DOUBLE * CASE WHEN hits.note_id IS NULL THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT) END AS c, seq * 10 + nth AS o FROM cn LEFT JOIN hits USING (note_id, denom) WHERE conf >= 15),
sc AS (SELECT note_id, denom, CAST(sum(e) AS BIGINT) AS exact_score, CAST(sum(c) AS BIGINT) AS confused_score, min(CASE WHEN e IS NOT NULL THEN o END) AS fe, min(CASE WHEN c IS NOT NULL THEN o END) AS fc FROM ts GROUP BY note_id, denom),
mg AS (SELECT note_id, denom, coalesce(exact_score, 0) + coalesce(CAST(trunc(confused_score * 0.5::DOUBLE) AS BIGINT), 0) AS score, fe IS NULL AS late, coalesce(fe, fc) AS o1 FROM sc)"""
        share = 0.10
    rest = f"""co AS (SELECT h.note_id, min(h.denom) AS denom, 40 AS score, true AS late, 0 AS o1 FROM hits h JOIN st USING (note_id) WHERE coloured_px >= total_px * {share} AND h.note_id NOT IN (SELECT note_id FROM mg) GROUP BY h.note_id HAVING count(*) = 1),
al AS (SELECT * FROM mg UNION ALL SELECT * FROM co),
rk AS (SELECT *, lead(denom) OVER w AS d2, lead(score) OVER w AS s2, row_number() OVER w AS k FROM al WINDOW w AS (PARTITION BY note_id ORDER BY score DESC, late, o1)),
tp AS (SELECT rk.*, score < coalesce(s2, 0) * 1.25 AND score < 80 AS close, EXISTS (SELECT 1 FROM hits h WHERE h.note_id = rk.note_id AND h.denom = rk.denom) AS a, EXISTS (SELECT 1 FROM hits h WHERE h.note_id = rk.note_id AND h.denom = rk.d2) AS b FROM rk WHERE k = 1),
dv AS (SELECT note_id, denom, CASE WHEN NOT close OR (a AND NOT b) THEN denom WHEN b AND NOT a THEN d2 END AS value, CASE WHEN close AND b AND NOT a THEN s2 ELSE score END AS vs FROM tp),
dc AS (SELECT n.note_id, 'denomination_classification' AS check_name, CASE WHEN value IS NULL THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN denom IS NULL OR dv.note_id IS NULL THEN 'Could not read denomination' WHEN value IS NULL THEN 'Denomination ambiguous' ELSE 'Denomination ' || value || ' (score ' || CAST(trunc(vs) AS BIGINT) || ')' END AS details, value FROM (SELECT note_id FROM fx_notes) n LEFT JOIN dv USING (note_id))"""
    return ",\n".join([_CANDIDATES, stats, pal, hits, scores, rest])


ORACLE_SQL = {
    "s9_ingest_words": oracle("SELECT note_id, seq, upper(trim(text)) AS text, CAST(trunc(conf / 100::DOUBLE * 100) AS INT) AS conf, x, CAST((y + y + h) // 2 AS INT) AS y, greatest(h, 1) AS h FROM fx_tokens WHERE conf / 100::DOUBLE >= 0.20::DOUBLE", "fx_tokens"),
    "t1_confusion_maps": oracle(f"SELECT note_id, seq, {_dig('text')} AS as_digits, {_let('text')} AS as_letters FROM fx_tokens", "fx_tokens"),
    "t2_prefixes": oracle(f"SELECT * FROM (SELECT note_id, seq, {_prefix('text')} AS prefix FROM fx_tokens) WHERE prefix IS NOT NULL", "fx_tokens"),
    "t3_digit_groups": oracle(f"SELECT * FROM (SELECT note_id, seq, {_digits('text')} AS digits FROM fx_tokens) WHERE digits IS NOT NULL", "fx_tokens"),
    "t4_single_token": oracle(_single("replace(text, ' ', '')"), "fx_tokens"),
    "t5_paired_tokens": oracle(_PARTS + "SELECT note_id, serial, conf, 1 AS part FROM pairs UNION ALL SELECT note_id, serial, conf, 2 FROM raws", "fx_tokens"),
    "t6_two_letter_pairs": oracle(f"q AS (SELECT *, {_let('text')} AS l, {_digits('text')} AS dig FROM fx_tokens) SELECT p.note_id, '?' || p.l || ' ' || d.dig AS serial, (p.conf + d.conf) / 2 AS conf FROM q p JOIN q d ON p.note_id = d.note_id AND p.seq <> d.seq AND length(p.text) = 2 AND regexp_matches(p.l, '^[A-Za-z]{{2}}$') AND d.dig IS NOT NULL AND p.x < d.x AND abs(p.y - d.y) <= greatest(d.h, 12)", "fx_tokens"),
    "t7_serials_in_text": f"WITH m AS (SELECT doc_id, regexp_extract_all(translate(text, '{_LOWER}', '{_LOWER.upper()}'), '[A-Z0-9OISB]{{3}}\\s?[0-9OISB]{{6,7}}') AS m FROM documents), x AS (SELECT doc_id, CAST(k - 1 AS INT) AS nth, regexp_extract(m[k], '^(...)\\s?(.*)$', 1) AS a, regexp_extract(m[k], '^(...)\\s?(.*)$', 2) AS b FROM m, unnest(generate_series(1, len(m))) g(k)) SELECT doc_id, nth, p || ' ' || d AS serial, 50 AS conf FROM (SELECT *, {_prefix('a')} AS p, {_digits('b')} AS d FROM x) WHERE p IS NOT NULL AND d IS NOT NULL",
    "t8_cross_variant": oracle(f"q AS (SELECT *, CASE WHEN y > 300 THEN 'bottom' ELSE 'top' END AS region, CASE WHEN regexp_matches(text, '^[A-Z0-9]{{3}}$') THEN {_prefix('text')} END AS pre, {_digits('text')} AS dig FROM fx_tokens) SELECT p.note_id, p.region, p.pre || ' ' || d.dig AS serial, (p.conf + d.conf) / 2 AS conf FROM q p JOIN q d ON p.note_id = d.note_id AND p.region = d.region AND p.pre IS NOT NULL AND d.dig IS NOT NULL AND p.x < d.x AND abs(p.y - d.y) <= greatest(p.h, d.h) * 1.5", "fx_tokens"),
    "t9_serial_vote": oracle(_PARTS + "SELECT * FROM best", "fx_tokens"),
    "t10_independent_vote": oracle(f"""q AS (SELECT note_id, seq, conf, {_digits('text')} AS d, CASE WHEN regexp_matches(text, '^[A-Z0-9]{{3}}$') THEN {_prefix('text')} END AS p FROM fx_tokens),
dd AS (SELECT note_id, d, CAST(sum(conf) AS BIGINT) AS s, min(seq) AS f FROM q WHERE d IS NOT NULL GROUP BY note_id, d QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY length(d), sum(conf) DESC, min(seq)) = 1),
pp AS (SELECT note_id, p, CAST(sum(conf) AS BIGINT) AS s, min(seq) AS f FROM q WHERE d IS NULL AND p IS NOT NULL GROUP BY note_id, p),
pr AS (SELECT *, row_number() OVER w AS k, coalesce(lead(s) OVER w, 0) AS runner FROM pp WINDOW w AS (PARTITION BY note_id ORDER BY s DESC, f))
SELECT dd.note_id, CASE WHEN dd.s < 40 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN dd.s >= 40 THEN CASE WHEN pr.s >= greatest(runner * 1.3, 50) THEN p ELSE '???' END || ' ' || d END AS value, dd.s AS digit_score, pr.s AS prefix_score FROM dd LEFT JOIN pr ON pr.note_id = dd.note_id AND k = 1""", "fx_tokens"),
    "t11_serial_tokens": oracle(f"SELECT note_id, seq, text FROM (SELECT *, replace(text, ' ', '') AS t FROM fx_tokens) WHERE conf >= 25 AND length(t) > 0 AND {_LOOKS}", "fx_tokens"),
    "t12_serial_region": oracle(f"b AS (SELECT *, replace(text, ' ', '') AS t, {_BOXED['w']} AS w FROM fx_tokens) SELECT note_id, CAST(greatest(x - greatest(8, w // 20), 0) AS INT) AS x0, CAST(least(x + w + greatest(8, w // 20), 1000) AS INT) AS x1, CAST(greatest(y - greatest(6, h // 8), 0) AS INT) AS y0, CAST(least(y + h + greatest(6, h // 8), 650) AS INT) AS y1 FROM b WHERE conf >= 25 AND {_LOOKS} QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY w * h DESC, seq) = 1", "fx_tokens"),
    "t13_serial_check": oracle(_PARTS + ", wc AS (SELECT note_id, count(*) AS words FROM fx_tokens GROUP BY note_id) SELECT n.note_id, 'ocr_serial_number' AS check_name, CASE WHEN serial IS NULL THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN words IS NULL THEN 'No readable text on note' WHEN serial IS NULL THEN 'No serial-shaped tokens' ELSE 'Serial read (' || votes || 'x, sum conf ' || conf_sum || ')' END AS details, b.serial AS value FROM (SELECT note_id FROM fx_notes) n LEFT JOIN wc USING (note_id) LEFT JOIN best b USING (note_id)", "fx_tokens"),
    "t14_serial_format": oracle(_PARTS + "SELECT note_id, serial, regexp_matches(serial, '^[A-Z0-9?]{3} [0-9]{6,7}$') AS valid FROM best", "fx_tokens"),
    "t15_tune_regions": oracle(f"""reg(candidate, y0, y1, x0, x1) AS ({values_sql(_REGIONS)}),
fr AS (SELECT note_id FROM fx_notes WHERE side <> 'reverse'),
hit AS (SELECT DISTINCT candidate, note_id FROM fx_tokens JOIN fr USING (note_id) JOIN reg ON y >= floor(650 * y0) AND y < floor(650 * y1) AND x >= floor(1000 * x0) AND x < floor(1000 * x1) WHERE regexp_matches(text, '[0-9OISB][A-Z08]{{2}}\\s*[0-9OISB]{{6,7}}'))
SELECT candidate, count(hit.note_id) AS hits, (SELECT count(*) FROM fr) AS total FROM (SELECT DISTINCT candidate FROM reg) LEFT JOIN hit USING (candidate) GROUP BY candidate""", "fx_tokens"),
    "d1_denom_candidates": oracle(_CANDIDATES + "SELECT note_id, seq, t AS text, nth, denom FROM cn", "fx_tokens"),
    "d1_denom_candidates_udtf": oracle(_CANDIDATES + "SELECT note_id, seq, t AS text, nth, denom FROM cn", "fx_tokens"),
    "d2_denom_scores": oracle(_scored(1) + "SELECT note_id, denom, exact_score, confused_score FROM sc", "fx_tokens", "fx_palette_stats"),
    "d3_palette_hits": oracle(_scored(1) + "SELECT note_id, denom FROM hits", "fx_tokens", "fx_palette_stats"),
    "d4_merged_scores": oracle(_scored(1) + "SELECT note_id, denom, score FROM mg", "fx_tokens", "fx_palette_stats"),
    "d5_colour_only": oracle(_scored(3) + "SELECT note_id, denom, score FROM co", "fx_tokens", "fx_palette_stats"),
    "d6_classify": oracle(_scored(3) + "SELECT * FROM dc", "fx_tokens", "fx_palette_stats"),
    "d7_classify_regions": oracle(_scored(1, region=True) + "SELECT note_id, status, value FROM dc", "fx_tokens", "fx_palette_stats"),
}
