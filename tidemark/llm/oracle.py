"""DuckDB SQL of the problems' queries, where SQL can say what they give on whole tables."""

from __future__ import annotations

from tidemark.plans.registry import clean as c
from tidemark.plans.registry import instant
from tidemark.plans.tables import MANIFEST, SAMPLES, TRAIN, VALIDATION, distance_sql, packed

P1 = f"""WITH {MANIFEST}, {TRAIN}, {VALIDATION}, al AS (SELECT sha, content, digest FROM t UNION SELECT sha, content, digest FROM v),
ev AS (SELECT DISTINCT al.* FROM al JOIN m ON al.sha = m.sha WHERE m.split IN ('validation', 'test')), tr AS (SELECT DISTINCT al.* FROM al JOIN m ON al.sha = m.sha WHERE m.split = 'train'),
{packed('x', 'ev', 'sha')}, {packed('y', 'tr', 'sha')},
p AS (SELECT ev.sha AS a, tr.sha AS b FROM ev JOIN tr ON ev.content = tr.content UNION SELECT x.sha, y.sha FROM x JOIN y ON least(abs(x.lv - y.lv), 256 - abs(x.lv - y.lv)) <= 1 WHERE {distance_sql('x', 'y')} <= 20)
SELECT DISTINCT least(a, b) AS sha_a, greatest(a, b) AS sha_b FROM p WHERE a <> b"""

#: The bits of equal values of two rows of packed().
_EQUAL = "128 - (" + " + ".join(f"bit_count((xor(x.w{k}, y.w{k}) | (xor(x.w{k}, y.w{k}) >> 1)) & 6148914691236517205::UBIGINT)" for k in range(4)) + ")"
P1_REPORT = P1[: P1.index("p AS (SELECT")] + f"""p AS (SELECT ev.sha AS a, tr.sha AS b, true AS exact, NULL AS d, NULL AS q FROM ev JOIN tr ON ev.content = tr.content
UNION ALL SELECT x.sha, y.sha, false, {distance_sql('x', 'y')}, {_EQUAL} FROM x JOIN y ON least(abs(x.lv - y.lv), 256 - abs(x.lv - y.lv)) <= 1 WHERE {distance_sql('x', 'y')} <= 20),
pr AS (SELECT a, b, bool_or(exact) AS exact, min(d) AS d, max(q) / 128.0 AS q FROM p WHERE a <> b GROUP BY a, b),
pe AS (SELECT a, count(*) AS pairs, count(*) FILTER (exact) AS exact_pairs, min(d) AS d, max(q) AS q FROM pr GROUP BY a),
ls AS (SELECT DISTINCT sha, split, source FROM m WHERE split IN ('validation', 'test'))
SELECT split, source, count(*) AS records, sum(pairs)::BIGINT AS pairs, sum(exact_pairs)::BIGINT AS exact_pairs, min(d)::INTEGER AS least_distance, round(avg(q), 6) AS mean_coverage FROM ls JOIN pe ON ls.sha = pe.a GROUP BY 1, 2"""

TERMS = f"""WITH {SAMPLES}, k AS (SELECT family FROM s WHERE family IS NOT NULL UNION SELECT {c('family')} FROM class_support WHERE family IS NOT NULL),
n AS (SELECT k.family, count(s.family) AS occurrences, count(DISTINCT s.sha) AS records FROM k LEFT JOIN s ON k.family = s.family GROUP BY 1),
q AS (SELECT *, CASE WHEN records < 5 THEN 'rare' WHEN records >= 0.1 * (SELECT count(DISTINCT sha) FROM s) THEN 'common' END AS mark FROM n) """

P3 = f"""WITH RECURSIVE {SAMPLES}, e AS (SELECT {c('sha_a')} AS a, {c('sha_b')} AS b FROM edges WHERE content_equal OR tlsh_distance <= 20),
l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b UNION SELECT sha, group_id FROM s WHERE sha <> group_id UNION SELECT group_id, sha FROM s WHERE sha <> group_id),
r AS (SELECT DISTINCT a AS sha, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON r.sha = l.a WHERE r.root < l.b)
SELECT sha, min(root) AS group_sha FROM r GROUP BY sha"""

P4 = f"""WITH {TRAIN}, vv AS (SELECT {c('sha')} AS sha, batch_no, {instant('timestamp')} AS seen, {c('disarmed_content_sha256')} AS content, tlsh, tlsh_status, row_number() OVER (PARTITION BY {c('sha')} ORDER BY batch_no, {instant('timestamp')}) AS k FROM validation_tlsh),
vd AS (SELECT sha, batch_no, seen, content, CASE WHEN {c('tlsh_status')} = 'valid' AND regexp_full_match({c('tlsh')}, '(t1)?[0-9a-f]{{70}}') THEN upper(right({c('tlsh')}, 70)) END AS digest FROM vv WHERE k = 1),
n AS (SELECT *, row_number() OVER (ORDER BY batch_no, seen, sha) AS pos FROM vd), {packed('x', 'n', 'sha, pos')}, {packed('y', 't', 'sha')}
SELECT sha FROM n WHERE content IN (SELECT content FROM t WHERE content IS NOT NULL)
UNION SELECT b.sha FROM n a JOIN n b ON a.content = b.content AND a.pos < b.pos
UNION SELECT x.sha FROM x JOIN y ON least(abs(x.lv - y.lv), 256 - abs(x.lv - y.lv)) <= 1 WHERE {distance_sql('x', 'y')} <= 10
UNION SELECT b.sha FROM x a JOIN x b ON a.pos < b.pos WHERE {distance_sql('a', 'b')} <= 10"""

P4_CASES = P4[: P4.index("SELECT sha FROM n WHERE content IN")] + ", cs AS (" + P4[P4.index("SELECT sha FROM n WHERE content IN") :] + ") SELECT coalesce(n.batch_no, 2147483647) AS batch_no, n.sha FROM n JOIN cs ON n.sha = cs.sha"

P5 = f"WITH {VALIDATION}, {packed('x', 'v', 'sha')} SELECT a.sha AS sha_a, b.sha AS sha_b FROM x a JOIN x b ON a.sha < b.sha WHERE {distance_sql('a', 'b')} <= 30"

#: Distinct digests with the least sha of each.
REPS = f"{VALIDATION}, rp AS (SELECT digest, min(sha) AS sha FROM v WHERE digest IS NOT NULL GROUP BY digest), {packed('x', 'rp', 'sha, digest')}"
P5_PAIRS = f"WITH {REPS} SELECT a.sha AS class_a, b.sha AS class_b, {distance_sql('a', 'b')} AS distance FROM x a JOIN x b ON a.sha < b.sha AND a.digest <> b.digest WHERE {distance_sql('a', 'b')} <= 30"
P5_CLASSES = f"WITH {REPS}, pr AS (SELECT a.digest AS d FROM x a JOIN x b ON a.digest <> b.digest WHERE {distance_sql('a', 'b')} <= 30), n AS (SELECT d, count(*) AS links FROM pr GROUP BY d) SELECT DISTINCT v.sha, rp.sha AS class_sha, coalesce(n.links, 0) AS links FROM v JOIN rp ON v.digest = rp.digest LEFT JOIN n ON n.d = v.digest"

P6 = f"""WITH {SAMPLES}, f AS (SELECT {c('sha')} AS sha, fold, {c('disarmed_content_sha256')} AS content FROM manifest WHERE retained AND fold BETWEEN 0 AND 4),
g AS (SELECT DISTINCT f.sha, f.fold, s.group_id FROM f JOIN s ON f.sha = s.sha WHERE s.group_id IS NOT NULL)
SELECT sha FROM g WHERE group_id IN (SELECT group_id FROM g GROUP BY group_id HAVING count(DISTINCT fold) > 1)
UNION SELECT sha FROM f WHERE content IN (SELECT content FROM f WHERE content IS NOT NULL GROUP BY content HAVING count(DISTINCT fold) > 1)"""


#: Rules that results must keep: what SQL can say of splits and mixtures, which it cannot make.
P6_GROUPS = f"WITH {SAMPLES} SELECT group_id, count(DISTINCT sha) AS records, 1::BIGINT AS splits FROM s WHERE group_id IS NOT NULL AND sha IS NOT NULL GROUP BY group_id"
P9_CHECK = """WITH h AS (SELECT DISTINCT source FROM documents WHERE text <> ''), t AS (SELECT source, sum(target_share) AS w FROM mix_target WHERE source IS NOT NULL AND target_share > 0 GROUP BY 1), u AS (SELECT sum(w) AS whole FROM t WHERE source IN (SELECT source FROM h))
SELECT source, round(CASE WHEN source IN (SELECT source FROM h) THEN w / whole ELSE 0 END, 6) AS expected_share, 0::BIGINT AS over_cap, true AS share_met FROM t, u"""

#: The rule in SQL's own terms: format characters and other characters that show nothing go, space separators are blanks,
#: full-width forms lie 65248 above their ordinary ones, look-alikes are listed (fixed values), with the accents that
#: nfc_normalize can put on both.
LOOKS = r"""ch AS (SELECT unnest(string_split('а с ԁ е һ і ј о р ԛ ѕ ѵ ԝ х у А В С Е Н І Ј К М О Р Ԛ Ѕ Т Ѵ Ԝ Х У ν ο Α Β Ε Ζ Η Ι Κ Μ Ν Ο Ρ Τ Υ Χ', ' ')) AS c, unnest(string_split('a c d e h i j o p q s v w x y A B C E H I J K M O P Q S T V W X Y v o A B E Z H I K M N O P T Y X', ' ')) AS l),
mk AS (SELECT chr(m::INTEGER) AS m FROM range(768, 880) t(m)),
tr AS (SELECT c, l FROM ch UNION ALL SELECT nfc_normalize(c || m), nfc_normalize(l || m) FROM ch, mk WHERE length(nfc_normalize(c || m)) = 1 AND length(nfc_normalize(l || m)) = 1
UNION ALL SELECT chr(x::INTEGER), chr((x - 65248)::INTEGER) FROM range(65281, 65375) t(x) UNION ALL SELECT unnest(['￠', '￡', '￢', '￣', '￤', '￥', '￦', '｟', '｠']), unnest(['¢', '£', '¬', '¯', '¦', '¥', '₩', '⦅', '⦆'])),
tl AS (SELECT string_agg(c, '' ORDER BY c) AS a, string_agg(l, '' ORDER BY c) AS b FROM (SELECT c, min(l) AS l FROM tr GROUP BY c)),
fm AS (SELECT doc_id, text, nfc_normalize(translate(nfc_normalize(regexp_replace(regexp_replace(text, '[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]', '', 'g'), '\p{Zs}', ' ', 'g')), tl.a, tl.b)) AS form FROM documents, tl)"""

P10 = f"WITH {LOOKS} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM fm a JOIN fm b ON a.form = b.form AND a.doc_id < b.doc_id WHERE a.text <> b.text AND trim(a.form, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''"

SQL = {
    "p1_found": P1,
    "p1_report": P1_REPORT,
    "p2_found": TERMS + "SELECT family, mark FROM q WHERE mark IS NOT NULL",
    "p2_terms": TERMS + "SELECT * FROM q",
    "p3_found": P3,
    "p4_found": P4,
    "p4_cases": P4_CASES,
    "p5_found": P5,
    "p5_pairs": P5_PAIRS,
    "p5_classes": P5_CLASSES,
    "p6_found": P6,
    "p6_group_splits": P6_GROUPS,
    "p9_check": P9_CHECK,
    "p10_found": P10,
    "p10_forms": f"WITH {LOOKS} SELECT doc_id, form FROM fm",
}
