"""Queries and oracle SQL of verdict fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from guilloche.operators import evaluate as E
from guilloche.operators import verdict as V

from .fixtures import load, oracle

_FORENSIC = """
f AS (SELECT note_id, count(*) FILTER (check_name <> 'modular_ai_pipeline' AND status = 'PASS') AS forensic_pass,
  count(*) FILTER (check_name <> 'modular_ai_pipeline' AND status IN ('PASS', 'FAIL')) AS forensic_total,
  bool_or(check_name = 'structural_sanity' AND status = 'FAIL') AS structural_fail, bool_or(check_name = 'hologram_detection' AND status = 'FAIL') AS palette_fail,
  bool_or(check_name = 'proportion_analysis' AND status = 'FAIL') AS proportion_fail FROM fx_checks GROUP BY note_id),
s AS (SELECT *, forensic_pass / greatest(forensic_total, 1) AS forensic_score FROM f),
c AS (SELECT s.*, raw, 0.4::DOUBLE * raw + 0.6::DOUBLE * forensic_score AS combined FROM s JOIN fx_scores USING (note_id)),
v AS (SELECT *, CASE WHEN structural_fail THEN 'FAKE' WHEN combined >= 0.65::DOUBLE AND forensic_pass >= 5 AND NOT palette_fail AND NOT proportion_fail THEN 'REAL'
  WHEN combined < 0.35::DOUBLE OR (raw < 0.35::DOUBLE AND forensic_score < 0.35::DOUBLE) THEN 'FAKE' ELSE 'SUSPICIOUS' END AS verdict FROM c)
"""


def _judged(spark, d):
    return V.verdicts(load(spark, d, "fx_checks"), load(spark, d, "fx_scores"))


def v1(spark, d):
    return V.model_verdict(load(spark, d, "fx_scores"))


def v2(spark, d):
    f = V.forensic_score(load(spark, d, "fx_checks"))
    return f.select("note_id", "forensic_pass", "forensic_total", F.round("forensic_score", 6).alias("forensic_score"))


def v3(spark, d):
    c = V.combine(V.forensic_score(load(spark, d, "fx_checks")), load(spark, d, "fx_scores"))
    return c.select("note_id", F.round("combined", 6).alias("combined"))


def v4(spark, d):
    return _judged(spark, d).select("note_id", "verdict", F.round("combined", 6).alias("combined"))


def v5(spark, d):
    return V.response(_judged(spark, d))


def v6(spark, d):
    return V.verdict_without_model(V.forensic_score(load(spark, d, "fx_checks"))).select("note_id", "verdict")


def e1(spark, d):
    return E.select_notes(load(spark, d, "fx_notes"), grade="phone", has_serial=True, side="obverse").select("note_id", "path", "denom", "serial")


def e2(spark, d):
    notes = load(spark, d, "fx_notes")
    return E.missing_files(notes, notes.where("note_id % 10 <> 0")).select("note_id", "path")


def e3(spark, d):
    return E.grade_tally(load(spark, d, "fx_notes").where("grade <> 'edge_case'"))


def e4(spark, d):
    return E.known_serials(load(spark, d, "fx_notes"))


def _read(spark, d):
    """What a reader would report: some denominations and serials off or missing."""
    return load(spark, d, "fx_notes").where("note_id % 17 <> 3").select("note_id", F.expr("CASE WHEN note_id % 5 = 0 THEN '500' ELSE denom END").alias("denom"), F.expr("CASE WHEN note_id % 6 = 1 THEN NULL ELSE concat(prefix, ' ', digits) END").alias("serial"))


_READ = "rd AS (SELECT note_id, CASE WHEN note_id % 5 = 0 THEN '500' ELSE denom END AS denom_read, CASE WHEN note_id % 6 = 1 THEN NULL ELSE concat(prefix, ' ', digits) END AS serial_read FROM fx_notes WHERE note_id % 17 <> 3),\nj AS (SELECT n.note_id, n.denom AS denom_expected, n.serial AS serial_expected, denom_read, serial_read, grade FROM fx_notes n LEFT JOIN rd USING (note_id))"


def e5(spark, d):
    return E.expected_actual(load(spark, d, "fx_notes"), _read(spark, d))


def e6(spark, d):
    notes = load(spark, d, "fx_notes")
    pairs = E.expected_actual(notes, _read(spark, d)).join(notes.select("note_id", "grade"), "note_id")
    serial = E.miss_count(pairs.where("grade = 'phone' and serial_expected is not null"), F.col("serial_expected"), F.col("serial_read"), tolerance_divisor=3).withColumn("what", F.lit("phone serial"))
    phone = E.miss_count(pairs.where("grade = 'phone'"), F.col("denom_expected"), F.col("denom_read"), tolerance_divisor=5).withColumn("what", F.lit("phone denom"))
    clean = E.miss_count(pairs.where("grade = 'clean'"), F.col("denom_expected"), F.col("denom_read"), tolerance_divisor=5).withColumn("what", F.lit("clean denom"))
    return serial.unionByName(phone).unionByName(clean)


def e7(spark, d):
    return E.spurious_serials(_read(spark, d), load(spark, d, "fx_notes")).select("note_id", "serial")


def e8(spark, d):
    return E.confusion(_judged(spark, d), load(spark, d, "fx_scores"))


def e9(spark, d):
    return E.separators(load(spark, d, "fx_checks"), load(spark, d, "fx_scores"))


def e10(spark, d):
    return E.signal_distribution(load(spark, d, "fx_signals"), "label")


def e11(spark, d):
    s = load(spark, d, "fx_scores").join(load(spark, d, "fx_notes").select("note_id", "grade", "fake_type"), "note_id")
    return E.signal_distribution(s.withColumn("bucket", E.bucket_of()), "bucket", value="raw")


def e12(spark, d):
    return E.found_rate(load(spark, d, "fx_signals"), "bucket", F.col("signal") > 50)


def e13(spark, d):
    return E.misclassified(_judged(spark, d), load(spark, d, "fx_scores"))


def e14(spark, d):
    return E.grade_sorted(load(spark, d, "fx_notes")).select("grade_rank", "path")


def e16(spark, d):
    return E.token_dump(load(spark, d, "fx_tokens"))


def e17(spark, d):
    return E.line_markers(load(spark, d, "fx_tokens"))


QUERIES = {
    "v1_model_verdict": v1, "v2_forensic_score": v2, "v3_combined_score": v3, "v4_verdict_gates": v4, "v5_response_record": v5, "v6_verdict_without_model": v6,
    "e1_select_notes": e1, "e2_missing_files": e2, "e3_grade_tally": e3, "e4_known_serials": e4, "e5_expected_actual": e5, "e6_miss_count": e6, "e7_spurious_serials": e7,
    "e8_confusion": e8, "e9_separators": e9, "e10_signal_distribution": e10, "e11_bucket_summary": e11, "e12_found_rate": e12, "e13_misclassified": e13, "e14_grade_sorted": e14, "e16_token_dump": e16, "e17_line_markers": e17,
}


def _distribution(key: str, value: str, table: str) -> str:
    return f"SELECT {key}, count(*) AS n, min({value}) AS lowest, list_sort(list({value}))[CAST(count(*) // 2 AS BIGINT) + 1] AS upper_median, max({value}) AS highest FROM {table} GROUP BY {key}"


def _miss(what: str, where: str, a: str, b: str, k: int) -> str:
    return f"SELECT '{what}' AS what, n, misses, allowed, misses <= allowed AS passed FROM (SELECT count(*) AS n, count(*) FILTER ({a} IS DISTINCT FROM {b}) AS misses, greatest(1, count(*) // {k}) AS allowed FROM j WHERE {where})"


ORACLE_SQL = {
    "v1_model_verdict": oracle("SELECT note_id, raw, CASE WHEN raw >= 0.5 THEN 'REAL' ELSE 'FAKE' END AS model_verdict, round_even(CASE WHEN raw >= 0.5 THEN raw * 100 ELSE (1 - raw) * 100 END, 2) AS model_confidence FROM fx_scores", "fx_scores"),
    "v2_forensic_score": oracle(_FORENSIC + "SELECT note_id, forensic_pass, forensic_total, round(forensic_score, 6) AS forensic_score FROM s", "fx_checks", "fx_scores"),
    "v3_combined_score": oracle(_FORENSIC + "SELECT note_id, round(combined, 6) AS combined FROM c", "fx_checks", "fx_scores"),
    "v4_verdict_gates": oracle(_FORENSIC + "SELECT note_id, verdict, round(combined, 6) AS combined FROM v", "fx_checks", "fx_scores"),
    "v5_response_record": oracle(_FORENSIC + "SELECT note_id, verdict AS prediction, round_even(greatest(combined, 1 - combined) * 100, 2) AS confidence_value, printf('%.2f%%', round_even(greatest(combined, 1 - combined) * 100, 2)) AS confidence, round_even(forensic_score * 100, 2) AS forensic_score_pct, forensic_pass, forensic_total, round(combined, 6) AS combined_score FROM v", "fx_checks", "fx_scores"),
    "v6_verdict_without_model": oracle(_FORENSIC + "SELECT note_id, CASE WHEN structural_fail THEN 'FAKE' WHEN forensic_score >= 0.65 AND forensic_pass >= 5 AND NOT palette_fail THEN 'REAL' WHEN forensic_score < 0.35 THEN 'FAKE' ELSE 'SUSPICIOUS' END AS verdict FROM s", "fx_checks", "fx_scores"),
    "e1_select_notes": oracle("SELECT note_id, path, denom, serial FROM fx_notes WHERE grade = 'phone' AND serial IS NOT NULL AND side = 'obverse'", "fx_notes"),
    "e2_missing_files": oracle("SELECT note_id, path FROM fx_notes WHERE path NOT IN (SELECT path FROM fx_notes WHERE note_id % 10 <> 0)", "fx_notes"),
    "e3_grade_tally": oracle("SELECT grade, count(note_id) AS n FROM (VALUES ('clean'), ('phone'), ('edge_case'), ('fake')) g(grade) LEFT JOIN (SELECT * FROM fx_notes WHERE grade <> 'edge_case') x USING (grade) GROUP BY grade", "fx_notes"),
    "e4_known_serials": oracle("SELECT path, denom, serial FROM fx_notes WHERE grade = 'phone' AND serial IS NOT NULL", "fx_notes"),
    "e5_expected_actual": oracle(_READ + "SELECT note_id, denom_expected, serial_expected, denom_read, serial_read, CASE WHEN denom_expected IS NOT DISTINCT FROM denom_read THEN 'OK ' ELSE 'BAD' END AS denom_mark, CASE WHEN serial_expected IS NULL OR serial_expected IS NOT DISTINCT FROM serial_read THEN 'OK ' ELSE 'BAD' END AS serial_mark FROM j", "fx_notes"),
    "e6_miss_count": oracle(_READ + " UNION ALL ".join([_miss("phone serial", "grade = 'phone' AND serial_expected IS NOT NULL", "serial_expected", "serial_read", 3), _miss("phone denom", "grade = 'phone'", "denom_expected", "denom_read", 5), _miss("clean denom", "grade = 'clean'", "denom_expected", "denom_read", 5)]), "fx_notes"),
    "e7_spurious_serials": oracle(_READ + "SELECT note_id, serial_read AS serial FROM rd WHERE serial_read IS NOT NULL AND note_id IN (SELECT note_id FROM fx_notes WHERE fake_type = 'structural')", "fx_notes"),
    "e8_confusion": oracle(_FORENSIC + "SELECT label, count(*) FILTER (verdict = 'REAL') AS \"real\", count(*) FILTER (verdict = 'SUSPICIOUS') AS suspicious, count(*) FILTER (verdict = 'FAKE') AS fake FROM v JOIN fx_scores USING (note_id) GROUP BY label", "fx_checks", "fx_scores"),
    "e9_separators": oracle("x AS (SELECT check_name, count(*) FILTER (label = 'real' AND status = 'PASS') AS real_pass, count(*) FILTER (label = 'real' AND status = 'FAIL') AS real_fail, count(*) FILTER (label = 'fake' AND status = 'PASS') AS fake_pass, count(*) FILTER (label = 'fake' AND status = 'FAIL') AS fake_fail, count(*) FILTER (label = 'real') AS n_real, count(*) FILTER (label = 'fake') AS n_fake FROM fx_checks JOIN fx_scores USING (note_id) GROUP BY check_name) SELECT *, real_pass + fake_fail AS separator FROM x", "fx_checks", "fx_scores"),
    "e10_signal_distribution": oracle(_distribution("label", "signal", "fx_signals"), "fx_signals"),
    "e11_bucket_summary": oracle("b AS (SELECT raw, CASE WHEN grade = 'fake' THEN 'fake/' || coalesce(fake_type, 'unknown') ELSE grade END AS bucket FROM fx_scores JOIN fx_notes USING (note_id))" + _distribution("bucket", "raw", "b"), "fx_scores"),
    "e12_found_rate": oracle("SELECT bucket, count(*) AS n, round(avg(CASE WHEN signal > 50 THEN 1 ELSE 0 END), 6) AS found_rate, round(avg(signal), 6) AS mean_value FROM fx_signals GROUP BY bucket", "fx_signals"),
    "e13_misclassified": oracle(_FORENSIC + "SELECT note_id, verdict, label, CASE WHEN label = 'real' THEN 'real_suspicious' ELSE 'fake_real' END AS kind FROM v JOIN fx_scores USING (note_id) WHERE (label = 'real' AND verdict = 'SUSPICIOUS') OR (label = 'fake' AND verdict = 'REAL')", "fx_checks", "fx_scores"),
    "e14_grade_sorted": oracle("SELECT CAST(CASE grade WHEN 'clean' THEN 0 WHEN 'phone' THEN 1 WHEN 'edge_case' THEN 2 WHEN 'fake' THEN 3 ELSE 9 END AS INT) AS grade_rank, path FROM fx_notes ORDER BY 1, 2", "fx_notes"),
    "e16_token_dump": oracle("t AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY conf DESC, seq) AS k FROM fx_tokens WHERE conf >= 30) SELECT note_id, string_agg(text, ' | ' ORDER BY k) AS tokens, count(*) AS n FROM t WHERE k <= 3 GROUP BY note_id", "fx_tokens"),
    "e17_line_markers": oracle("l AS (SELECT note_id, string_agg(text, ' ' ORDER BY seq) AS line FROM fx_tokens GROUP BY note_id) SELECT note_id, line, CASE WHEN regexp_matches(line, '[A-Za-z]') AND regexp_matches(line, '[0-9]') THEN 'both' WHEN regexp_matches(line, '[A-Za-z]') THEN 'letters' WHEN regexp_matches(line, '[0-9]') THEN 'digits' ELSE 'none' END AS marker FROM l", "fx_tokens"),
}
