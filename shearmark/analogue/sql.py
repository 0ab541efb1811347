"""The views of ``views.py`` and the shared statistics, stated for the oracle engine.

``with_views`` puts the common table expressions a query names in front of it,
in dependency order.
"""

from __future__ import annotations

import re

from ..schemas import METHODS, MODE_NAMES, REFERENCE_METHODS, TRIMMED_METHODS
from .views import CUTOFF


def r6(expr: str) -> str:
    """Six decimals, without a negative zero."""
    return f"round({expr}, 6) + 0.0"


def _modes(kind: str) -> str:
    return ", ".join(f"('{m}', {i}, {CUTOFF[m]}.0, '{MODE_NAMES[m]}')" for i, m in enumerate(METHODS)
                     if kind == "all" or m != "U")


MODE_NAME = "CASE {0} " + " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in MODE_NAMES.items()) + " END"
DELTAS = ", ".join(f"max(CASE WHEN method = '{m}' THEN rho_pathway END) "
                   f"- max(CASE WHEN method = 'U' THEN rho_pathway END) AS {m}_delta_path" for m in TRIMMED_METHODS)
CLASSES = ", ".join(f"CASE WHEN {m}_delta_path > 0.05 THEN 'helpful' WHEN {m}_delta_path < -0.05 THEN 'harmful' "
                    f"WHEN {m}_delta_path IS NOT NULL THEN 'neutral' END AS {m}_class" for m in TRIMMED_METHODS)
BEST = "greatest(" + ", ".join(f"{m}_delta_path" for m in TRIMMED_METHODS) + ")"
CHOICE = "CASE " + " ".join(f"WHEN {m}_delta_path > 0.05 AND {m}_delta_path = {BEST} THEN '{m}'"
                            for m in TRIMMED_METHODS) + " ELSE 'U' END"

VIEWS = {
    "modes": f"SELECT * FROM (VALUES {_modes('all')}) AS v(method, ord, cutoff, mode_name)",
    "reads": """SELECT 'P' || (l_orderkey % 3) AS project, 'S' || ((l_orderkey // 3) % 20) AS srr,
        CASE WHEN (l_orderkey // 3) % 20 < 10 THEN 'control' ELSE 'treatment' END AS condition,
        'g' || (l_partkey % 200) AS gene, l_quantity AS q FROM lineitem""",
    "counts": """SELECT project, srr, method AS mode, gene, count(*) AS "count" FROM reads JOIN modes ON q > cutoff
        GROUP BY ALL""",
    "samples": "SELECT DISTINCT project, srr, condition FROM reads",
    "gene_sets": """SELECT DISTINCT unnest(['mod' || (p_partkey % 200 % 8), 'div' || (p_partkey % 200 // 40)]) AS set_name,
        'na' AS description, 'g' || (p_partkey % 200) AS gene FROM part""",
    "trim": """SELECT 'SRR' || l_orderkey AS SRR_ID, 'P' || (l_orderkey % 3) AS project_id, mode_name AS mode,
        CASE WHEN l_orderkey % 4 = 0 THEN 'SE' ELSE 'PE' END AS layout, count(*) AS input_reads,
        count(*) FILTER (l_quantity > cutoff) AS surviving,
        CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE count(*) FILTER (l_quantity > cutoff) / count(*) * 100 END
            AS surviving_pct, l_orderkey AS row_no
        FROM lineitem, modes WHERE method <> 'U' GROUP BY l_orderkey, mode_name""",
    "thr": """SELECT 'SRR' || o_custkey AS SRR_ID,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'fastqc' WHEN '2' THEN 'sra_conversion' WHEN '3' THEN 'trim'
            WHEN '4' THEN 'align' ELSE 'count' END AS category,
        CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN NULL WHEN o_orderstatus = 'F' THEN 'untrimmed'
            WHEN o_orderstatus = 'O' THEN 'adapter_only' ELSE 'P5' END AS mode,
        CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS duration_sec,
        CAST(o_orderkey % 8 + 1 AS DOUBLE) AS cores_used,
        CASE WHEN o_orderkey % 101 = 0 THEN 0.0 ELSE CAST(o_custkey % 3000 + 500 AS DOUBLE) END AS fastq_mb,
        (o_orderkey % 50) / 4.0::DOUBLE AS mb_per_sec FROM orders""",
    "cost": """SELECT *, fastq_mb / 1024 AS fastq_gb, duration_sec * cores_used / 3600 AS core_hours,
        (duration_sec * cores_used / 3600) / nullif(fastq_mb / 1024, 0) AS core_hours_per_gb FROM thr""",
    "fetches": """SELECT 'SRR' || user_id AS srr_id, event_type AS endpoint,
        CASE WHEN event_id % 10 < 7 THEN 'success' WHEN event_id % 10 < 9 THEN 'failed' ELSE 'pending' END AS status,
        epoch_us(ts) AS started_us,
        CASE WHEN event_id % 50 <> 0 THEN epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) END AS finished_us,
        event_id % 7 * 1000000 + event_id % 1000 AS bytes_downloaded FROM events""",
    "rate": """SELECT *, (finished_us - started_us) / 1e6 AS duration_sec, bytes_downloaded / 1e6 AS mb_downloaded,
        (bytes_downloaded / 1e6) / nullif((finished_us - started_us) / 1e6, 0) AS mb_per_sec FROM fetches""",
    "queue": """SELECT 'PRJ' || o_custkey AS project_id, 'SRR' || o_orderkey AS srr_id,
        CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'submitted'
            WHEN o_orderkey % 2 = 0 THEN 'todo' ELSE 'abandoned' END AS status,
        nullif(o_orderpriority, '5-LOW') AS run_status, o_orderkey FROM orders""",
    "id_files": "SELECT project_id, srr_id FROM queue WHERE o_orderkey % 11 <> 0",
    "n_files": "SELECT project_id, count(*) AS n_files FROM id_files GROUP BY 1",
    "n_ids": "SELECT project_id, count(*) AS n_files FROM queue GROUP BY 1",
    "filtered": "SELECT project_id, count(*) AS n_runs FROM queue GROUP BY 1 HAVING count(*) > 10 AND count(*) < 50",
    "meta": """SELECT 'PRJ' || (c_custkey // 5) AS project, 'SRR' || c_custkey AS Run, c_mktsegment AS condition,
        CASE c_nationkey % 3 WHEN 1 THEN 'PAIRED' WHEN 2 THEN 'SINGLE' END AS layout FROM customer""",
    "classes": "SELECT project, condition, count(*) AS n FROM meta GROUP BY 1, 2",
    "panel0": """SELECT project, CAST(sum(n) AS BIGINT) AS total_srrs, count(*) AS total_classes,
        count(*) FILTER (n >= 2) AS classes_with_replicates,
        CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS eligible FROM classes GROUP BY 1""",
    "panel": """SELECT project, total_srrs, total_classes, classes_with_replicates,
        CASE WHEN classes_with_replicates >= 2 THEN eligible ELSE 0 END AS eligible_srrs,
        CASE WHEN classes_with_replicates >= 2 THEN 'Yes' ELSE 'No' END AS included,
        CASE WHEN classes_with_replicates >= 2 THEN NULL
            WHEN total_classes = 1 AND classes_with_replicates = 0 THEN 'Only 1 class exists, and it has no replicates'
            WHEN total_classes = 1 THEN 'Only 1 class exists (DESeq2 requires >= 2 to compare)'
            ELSE 'Has ' || total_classes || ' classes, but only ' || classes_with_replicates || ' have replicates'
        END AS reason FROM panel0""",
    "ints": """SELECT *, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS x,
        CAST(l_quantity AS BIGINT) AS qi FROM lineitem""",
    "qual": """SELECT 'SRR' || l_orderkey AS SRR_ID, 'P' || (l_orderkey % 3) AS project_id,
        CAST(count(*) AS DOUBLE) AS sequence_depth, sum(d) / count(*) + 28 AS Q_mean,
        CAST(max(d) + 28 AS DOUBLE) AS Q_median, sum(qi) / count(*) AS read_length_mean,
        count(*) FILTER (d < 2) / count(*) AS frac_below_q20, count(*) FILTER (d < 5) / count(*) AS frac_below_q30,
        sum(x) / count(*) / 4.0::DOUBLE AS tail_quality_decay, count(*) FILTER (qi < 5) / count(*) AS adapter_rate,
        count(*) FILTER (l_returnflag = 'R') / count(*) AS duplication_rate,
        count(*) FILTER (l_linestatus = 'O') / count(*) AS n_content,
        sum(l_partkey % 100) / count(*) AS gc_content, sum(l_suppkey % 10) / count(*) AS gc_deviation
        FROM ints GROUP BY l_orderkey""",
    "qcpos": """SELECT 'P' || (l_suppkey % 3) AS project_id, 'SRR' || l_suppkey AS SRR_ID, l_linenumber % 2 + 1 AS mate,
        CAST(l_quantity AS INTEGER) AS pos, sum(d) / count(*) + 28 AS mean_q FROM ints GROUP BY ALL""",
    "terminal": """SELECT project_id, SRR_ID, avg(tail) AS terminal_q_mean FROM (
        SELECT project_id, SRR_ID, mate, avg(mean_q) AS tail FROM (
            SELECT *, row_number() OVER (PARTITION BY project_id, SRR_ID, mate ORDER BY pos DESC) AS rn FROM qcpos)
        WHERE rn <= 10 GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "qfull": """SELECT q.*, coalesce(t.terminal_q_mean, Q_mean - tail_quality_decay) AS terminal_q_mean
        FROM qual q LEFT JOIN terminal t USING (project_id, SRR_ID)""",
    "conc": """SELECT project, SRR_ID, method, CASE WHEN kept > 0 THEN kept / n END AS rho_gene,
            l / lines AS jaccard_deg, CASE WHEN kept > 0 THEN 1.0 - ds / (kept * 20.0::DOUBLE) END AS rho_pathway,
            CASE WHEN kept > 0 THEN ds / (kept * 10.0::DOUBLE) END AS jaccard_pathway,
            CASE WHEN flags > 0 THEN f / flags END AS dir_concordance
        FROM (SELECT 'P' || (l_orderkey % 3) AS project, 'SRR' || l_orderkey AS SRR_ID, method, count(*) AS n,
            sum(l_linenumber) AS lines, count(*) FILTER (l_returnflag = 'A') AS flags,
            count(*) FILTER (l_quantity > cutoff) AS kept,
            coalesce(sum(l_linenumber) FILTER (l_quantity > cutoff), 0) AS l,
            coalesce(sum(d) FILTER (l_quantity > cutoff), 0) AS ds,
            count(*) FILTER (l_quantity > cutoff AND l_returnflag = 'A') AS f
            FROM ints, modes GROUP BY l_orderkey, method)""",
    "deltas": f"SELECT project AS project_id, SRR_ID, {DELTAS} FROM conc GROUP BY 1, 2",
    "cls": f"SELECT *, {CLASSES}, {CHOICE} AS t_star FROM deltas",
    "pred": """SELECT SRR_ID, project_id, t_star AS True_t_star, CASE WHEN P35_delta_path > 0.1 THEN 'P35'
        WHEN P20_delta_path > 0.05 THEN 'P20' ELSE 'U' END AS Predicted_t_star FROM cls""",
    "outliers": f"""SELECT c.project_id, c.SRR_ID, t_star,
            CASE t_star {' '.join(f"WHEN '{m}' THEN {m}_delta_path" for m in TRIMMED_METHODS)} END AS preferred_delta_path,
            100.0::DOUBLE - s.surviving_pct AS preferred_read_loss_pct
        FROM cls c LEFT JOIN trim s ON s.SRR_ID = c.SRR_ID AND s.mode = {MODE_NAME.format('c.t_star')}
        WHERE t_star <> 'U'""",
    "evaluation": f"""SELECT p.*, {', '.join('q.' + f for f in (
        'sequence_depth', 'Q_mean', 'Q_median', 'read_length_mean', 'frac_below_q20', 'frac_below_q30',
        'tail_quality_decay', 'adapter_rate', 'duplication_rate', 'n_content', 'gc_content', 'gc_deviation'))},
        c.t_star, CASE WHEN c.t_star = 'U' THEN 0 ELSE 1 END AS benefits_from_trimming
        FROM pred p LEFT JOIN qual q USING (SRR_ID, project_id)
        LEFT JOIN cls c USING (SRR_ID, project_id)""",
    "paths": """SELECT 'data/flattened_' || regexp_extract(url, '^https?://[^/]+/([a-z]+)/(\\d+)', 1) || '/'
            || regexp_extract(url, '^https?://([^/]+)/', 1) || '/SRR'
            || regexp_extract(url, '^https?://[^/]+/([a-z]+)/(\\d+)', 2) || '_x.txt' AS path,
        regexp_extract(url, '^https?://([^/]+)/', 1) AS host,
        regexp_extract(url, '^https?://[^/]+/([a-z]+)/(\\d+)', 1) AS lang,
        regexp_extract(url, '^https?://[^/]+/([a-z]+)/(\\d+)', 2) AS number, page_id FROM pages""",
    "cohort": "SELECT DISTINCT host AS project FROM paths WHERE page_id % 3 = 0",
    "runs": """SELECT o_orderpriority AS mode, o_orderstatus AS aligner, o_totalprice AS duration_sec,
        (o_custkey % 30) / 10.0::DOUBLE AS aligned_input_gb FROM orders""",
    "annotation": """SELECT 'PRJ' || c_nationkey AS BioProject, 'SRR' || c_custkey AS SRR_ID,
        CASE WHEN c_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS condition,
        c_mktsegment AS condition_original,
        CASE WHEN c_custkey % 19 = 0 THEN 'x' ELSE CAST(c_custkey % 4 AS VARCHAR) END AS "group",
        CASE c_custkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN '' END AS exclude FROM customer""",
    "raw_diff": """SELECT p_partkey AS gene, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size - 25.0::DOUBLE END AS log2fc,
        CASE WHEN p_partkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE p_size / 10.0::DOUBLE END AS stat,
        CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size / 50.0::DOUBLE END AS pvalue,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size / 50.0::DOUBLE END AS padj FROM part""",
    "parts_t": """SELECT 'P' || (l_orderkey % 3) AS project, (l_orderkey // 3) % 60 AS s, m.mode, c.category,
            CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = m.flag AND l_linenumber % 3 = c.third), 0)
                AS BIGINT) AS sec
        FROM lineitem, (VALUES ('A', 'adapter_only'), ('N', 'untrimmed'), ('R', 'P5')) AS m(flag, mode),
            (VALUES (0, 'trim'), (1, 'align'), (2, 'count')) AS c(third, category) GROUP BY ALL""",
    "modes_t": """SELECT project, s, mode, sum(sec) AS summed,
        CAST(sum(sec) + CASE WHEN s % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS recorded FROM parts_t GROUP BY project, s, mode""",
    "timings": """SELECT project, 'S' || s AS srr, category || '_' || mode AS stage, category, mode, sec AS duration_sec FROM parts_t
        UNION ALL SELECT project, 'S' || s, 'mode_' || mode || '_total', NULL, NULL, recorded FROM modes_t
        UNION ALL SELECT project, 'S' || s, 'pipeline_total', NULL, NULL,
            CAST(sum(recorded) + CASE WHEN s % 23 = 0 THEN 1 ELSE 0 END AS BIGINT) FROM modes_t GROUP BY project, s""",
    "universe": "SELECT DISTINCT project, gene FROM counts WHERE mode = 'U'",
}


def wald_sql(src: str, keys: str) -> str:
    """log2fc, stat and pvalue from the per-condition sums of ``src``."""
    return tested_sql(f"({dispersion_sql(src)})", keys)


def dispersion_sql(src: str) -> str:
    return f"""SELECT *, greatest(coalesce((w - m * r) / nullif(m * m, 0), 0.0), 1e-8) AS a FROM (
        SELECT *, (greatest(q0 - n0 * m0 * m0, 0.0) + greatest(q1 - n1 * m1 * m1, 0.0)) / nullif(n0 + n1 - 2.0, 0) AS w,
            (s0 + s1) / (n0 + n1) AS m, (r0 + r1) / (n0 + n1) AS r FROM (
        SELECT *, s0 / n0 AS m0, s1 / n1 AS m1 FROM {src}))"""


def tested_sql(src: str, keys: str) -> str:
    erfc = ("u * exp(-1.26551223 + u * (1.00002368 + u * (0.37409196 + u * (0.09678418 + u * (-0.18628806 + u * "
            "(0.27886807 + u * (-1.13520398 + u * (1.48851587 + u * (-0.82215223 + u * 0.17087277)))))))) - z * z)")
    return f"""SELECT {keys}, coalesce(b / ln(2.0::DOUBLE), 0.0) AS log2fc, coalesce(stat, 0.0) AS stat,
            coalesce({erfc}, 1.0) AS pvalue FROM (
        SELECT *, abs(stat) / sqrt(2.0::DOUBLE) AS z, 1.0 / (1.0 + abs(stat) / sqrt(2.0::DOUBLE) / 2.0) AS u FROM (
        SELECT *, b / nullif(sqrt(v0 + v1), 0) AS stat FROM (
        SELECT *, (m0 * (r0 / n0) + a * m0 * m0) / n0 / ((m0 + 0.5) * (m0 + 0.5)) AS v0,
            (m1 * (r1 / n1) + a * m1 * m1) / n1 / ((m1 + 0.5) * (m1 + 0.5)) AS v1,
            CASE WHEN m > 0 THEN ln((m1 + 0.5) / (m0 + 0.5)) END AS b FROM {src})))"""


def bh_sql(src: str, keys: str) -> str:
    return f"""SELECT * EXCLUDE (raw), least(1.0, min(raw) OVER (PARTITION BY {keys} ORDER BY pvalue DESC)) AS padj FROM (
        SELECT *, pvalue * count(*) OVER (PARTITION BY {keys}) / count(*) OVER (PARTITION BY {keys} ORDER BY pvalue) AS raw
        FROM {src})"""


def enrich_views(prefix: str, src: str, keys: str, n_perm: int = 100) -> dict[str, str]:
    """ES and NES of every set in every test of ``src``; the result view is ``{prefix}_nes``."""
    def score(hits: str, by: str) -> str:
        return f"""SELECT {by}, set_name, CASE WHEN round(max(after) + min(before), 9) >= 0 THEN max(after)
                ELSE min(before) END AS es FROM (
            SELECT *, cum / nullif(nr, 0) - (pos - i) / nullif(n - nh, 0) AS after,
                (cum - w) / nullif(nr, 0) - (pos - i) / nullif(n - nh, 0) AS before FROM (
            SELECT *, sum(w) OVER (PARTITION BY {by}, set_name ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum,
                row_number() OVER (PARTITION BY {by}, set_name ORDER BY pos) AS i,
                sum(w) OVER (PARTITION BY {by}, set_name) AS nr, count(*) OVER (PARTITION BY {by}, set_name) AS nh
            FROM {hits})) GROUP BY {by}, set_name"""

    p = prefix
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return {
        f"{p}_ranked": f"""SELECT * FROM (SELECT {keys}, gene, abs(stat) AS w,
            row_number() OVER (PARTITION BY {keys} ORDER BY stat DESC, gene) AS pos,
            count(*) OVER (PARTITION BY {keys}) AS n FROM {src} WHERE stat <> 0) WHERE n >= 50""",
        f"{p}_hits": f"""SELECT * FROM (SELECT r.*, set_name, count(*) OVER (PARTITION BY {keys}, set_name) AS size
            FROM {p}_ranked r JOIN gene_sets USING (gene)) WHERE size BETWEEN 15 AND 500""",
        f"{p}_es": score(f"{p}_hits", keys),
        f"{p}_perm": f"""SELECT {keys}, perm, gene, n, row_number() OVER (PARTITION BY {keys}, perm
            ORDER BY md5(gene || '|' || perm || '|42')) AS pos
            FROM {p}_ranked, (SELECT unnest(range(1, {n_perm + 1})) AS perm)""",
        f"{p}_null_hits": f"""SELECT {ak}, a.perm, h.set_name, a.n, a.pos, b.w FROM {p}_perm a
            JOIN {p}_ranked b ON {on} AND a.pos = b.pos
            JOIN {p}_hits h ON {on.replace('b.', 'h.')} AND a.gene = h.gene""",
        f"{p}_null": f"""SELECT {keys}, set_name, avg(es) FILTER (es > 0) AS up, avg(-es) FILTER (es < 0) AS down
            FROM ({score(f"{p}_null_hits", keys + ", perm")}) GROUP BY {keys}, set_name""",
        f"{p}_nes": f"""SELECT {keys}, set_name AS pathway, es, es / nullif(CASE WHEN es >= 0 THEN up ELSE down END, 0) AS nes
            FROM {p}_es LEFT JOIN {p}_null USING ({keys}, set_name)""",
    }


# Whole-project tests: one per (project, mode), library-size factors within the test.
VIEWS.update({
    "lib": """SELECT project, mode, srr, total / avg(total) OVER (PARTITION BY project, mode) AS sf FROM (
        SELECT project, mode, srr, CAST(sum("count") AS DOUBLE) AS total FROM counts GROUP BY 1, 2, 3)""",
    "design": "SELECT lib.*, condition, CASE condition WHEN 'control' THEN 0 ELSE 1 END AS role FROM lib JOIN samples USING (project, srr)",
    "design_sums": """SELECT project, mode, CAST(count(*) FILTER (role = 0) AS DOUBLE) AS n0,
        CAST(count(*) FILTER (role = 1) AS DOUBLE) AS n1, sum(1 / sf) FILTER (role = 0) AS r0,
        sum(1 / sf) FILTER (role = 1) AS r1 FROM design GROUP BY 1, 2""",
    "gene_sums": """SELECT project, mode, gene, coalesce(sum("count" / sf) FILTER (role = 0), 0.0) AS s0,
        coalesce(sum("count" / sf) FILTER (role = 1), 0.0) AS s1,
        coalesce(sum(("count" / sf) * ("count" / sf)) FILTER (role = 0), 0.0) AS q0,
        coalesce(sum(("count" / sf) * ("count" / sf)) FILTER (role = 1), 0.0) AS q1
        FROM counts JOIN design USING (project, mode, srr) GROUP BY 1, 2, 3""",
    "moments": "SELECT * FROM gene_sums JOIN design_sums USING (project, mode)",
    "fit": wald_sql("moments", "project, mode, gene"),
    "diff": bh_sql("fit", "project, mode"),
    "disp": dispersion_sql("moments"),
    "trend": """SELECT project, mode, sy / nullif(n, 0) - slope * sx / nullif(n, 0) AS a0, slope AS a1 FROM (SELECT *,
        CASE WHEN n > 2 AND n * sxx - sx * sx > 1e-12 * n * sxx THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0.0 END AS slope FROM (
        SELECT project, mode, CAST(count(*) FILTER (ok) AS DOUBLE) AS n, sum(1 / m) FILTER (ok) AS sx, sum(a) FILTER (ok) AS sy,
            sum(1 / m / m) FILTER (ok) AS sxx, sum(a / m) FILTER (ok) AS sxy
        FROM (SELECT *, a > 1e-8 AND m > 0 AS ok FROM disp) GROUP BY 1, 2))""",
    "trended": """SELECT *, a > 1e-8 AND m > 0 AS ok, greatest(a0 + coalesce(a1 / nullif(m, 0), 0.0), 1e-8) AS t,
        list_sum(list_transform(range(6), lambda i: 1 / ((n0 + n1 - 2) / 2 + i) ^ 2)) + 1 / ((n0 + n1 + 10) / 2)
            + 1 / 2.0::DOUBLE / ((n0 + n1 + 10) / 2) ^ 2 + 1 / 6.0::DOUBLE / ((n0 + n1 + 10) / 2) ^ 3 - 1 / 30.0::DOUBLE / ((n0 + n1 + 10) / 2) ^ 5 AS noise
        FROM disp JOIN trend USING (project, mode)""",
    "shrunk": """SELECT * EXCLUDE (a), CASE WHEN ok THEN exp((p * ln(a) + noise * ln(t)) / (p + noise)) ELSE t END AS a FROM (
        SELECT *, greatest(var_pop(CASE WHEN ok THEN ln(a) - ln(t) END) OVER (PARTITION BY project, mode) - noise, 0.25) AS p FROM trended)""",
    "fit_shrunk": tested_sql("shrunk", "project, mode, gene"),
    "diff_shrunk": bh_sql("fit_shrunk", "project, mode"),
    **enrich_views("proj", "diff", "project, mode"),
})

# Leave-one-out tests, expanded sample by sample: the brute-force form of what the Spark plan gets by subtraction.
REFS = ", ".join(f"'{m}'" for m in REFERENCE_METHODS)
KEYS = "project, srr, stage, method"
VIEWS.update({
    "depth": """SELECT project, avg(total) AS depth FROM (SELECT project, srr, sum("count") AS total FROM counts
        WHERE mode = 'U' GROUP BY 1, 2) GROUP BY 1""",
    "fac": """SELECT c.project, c.srr, c.mode, condition, sum("count") / any_value(depth) AS sf
        FROM counts c JOIN depth USING (project) JOIN samples USING (project, srr) GROUP BY 1, 2, 3, 4""",
    "rest": """SELECT t.project, t.srr, o.condition, count(*) AS n FROM samples t JOIN samples o
        ON t.project = o.project AND t.srr <> o.srr GROUP BY 1, 2, 3""",
    "leave": "SELECT project, srr, min(n) >= 3 AS leave FROM rest GROUP BY 1, 2",
    "members": f"""SELECT l.project, l.srr, 'reference' AS stage, f.mode AS method, f.srr AS other, f.mode, f.condition, f.sf
        FROM leave l JOIN fac f ON f.project = l.project AND f.mode IN ({REFS}) AND NOT (l.leave AND f.srr = l.srr)
        UNION ALL
        SELECT l.project, l.srr, 'candidate', m.mode, f.srr, f.mode, f.condition, f.sf
        FROM leave l JOIN fac m ON m.project = l.project AND m.srr = l.srr
        JOIN fac f ON f.project = l.project AND f.mode = 'U' AND NOT (l.leave AND f.srr = l.srr)
        UNION ALL
        SELECT l.project, l.srr, 'candidate', m.mode, m.srr, m.mode, m.condition, m.sf
        FROM leave l JOIN fac m ON m.project = l.project AND m.srr = l.srr""",
    "member_sums": f"""SELECT {KEYS}, CAST(count(*) FILTER (condition = 'control') AS DOUBLE) AS n0,
        CAST(count(*) FILTER (condition = 'treatment') AS DOUBLE) AS n1,
        sum(1 / sf) FILTER (condition = 'control') AS r0, sum(1 / sf) FILTER (condition = 'treatment') AS r1
        FROM members GROUP BY {KEYS} HAVING n0 > 0 AND n1 > 0 AND (stage = 'candidate' OR n0 + n1 >= 4)""",
    "member_genes": f"""SELECT m.project, m.srr, stage, method, gene,
        sum("count" / sf) FILTER (condition = 'control') AS s0, sum("count" / sf) FILTER (condition = 'treatment') AS s1,
        sum(("count" / sf) * ("count" / sf)) FILTER (condition = 'control') AS q0,
        sum(("count" / sf) * ("count" / sf)) FILTER (condition = 'treatment') AS q1
        FROM members m JOIN counts c ON c.project = m.project AND c.srr = m.other AND c.mode = m.mode GROUP BY ALL""",
    "loso_moments": f"""SELECT t.*, u.gene, coalesce(s0, 0.0) AS s0, coalesce(s1, 0.0) AS s1, coalesce(q0, 0.0) AS q0,
        coalesce(q1, 0.0) AS q1 FROM member_sums t JOIN universe u USING (project)
        LEFT JOIN member_genes g USING ({KEYS}, gene)""",
    "loso_fit": wald_sql("loso_moments", f"{KEYS}, gene"),
    "loso_diff": bh_sql("loso_fit", KEYS),
    **enrich_views("loso", "loso_diff", KEYS),
})


def spearman_sql(src: str, keys: str, x: str, y: str) -> str:
    """Spearman correlation per group of complete pairs, null under 10."""
    return f"""SELECT {keys}, count(*) AS n_pairs, CASE WHEN count(*) >= 10 THEN
            covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) END AS rho FROM (
        SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2 AS rx,
            rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2 AS ry
        FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys}"""


def concordance_views(prefix: str, cand: str, cand_nes: str, ref: str, ref_nes: str, by: str, on: str,
                      fdr: float, lfc: float) -> dict[str, str]:
    """The five agreement measures as ``{prefix}_conc``."""
    p = prefix

    def index(name: str, table: str, sig: str, key: str) -> str:
        return f"""SELECT {by}, coalesce(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a OR b), 0), 1.0) AS {name}
            FROM (SELECT {by}, {key}, bool_or(a) AS a, bool_or(b) AS b FROM (
                SELECT {by}, {key}, TRUE AS a, FALSE AS b FROM {p}_tests JOIN {table} USING ({on}) WHERE voted
                UNION ALL SELECT {by}, {key}, FALSE, TRUE FROM {sig}
                UNION ALL SELECT {by}, NULL, FALSE, FALSE FROM {p}_tests) GROUP BY {by}, {key}) GROUP BY {by}"""

    return {
        f"{p}_tests": f"SELECT DISTINCT {by} FROM {cand}",
        f"{p}_gene_pairs": f"SELECT * FROM {cand} JOIN {ref} USING ({on}, gene)",
        f"{p}_path_pairs": f"SELECT * FROM {cand_nes} JOIN {ref_nes} USING ({on}, pathway)",
        f"{p}_rho_gene": spearman_sql(f"{p}_gene_pairs", by, "stat", "ref_stat"),
        f"{p}_rho_path": spearman_sql(f"{p}_path_pairs", by, "nes", "ref_nes"),
        f"{p}_deg": f"SELECT * FROM {cand} WHERE padj < {fdr} AND abs(log2fc) > {lfc}",
        f"{p}_sig": f"SELECT * FROM {cand_nes} WHERE abs(nes) > 1.0",
        f"{p}_j_deg": index("jaccard_deg", ref, f"{p}_deg", "gene"),
        f"{p}_j_path": index("jaccard_pathway", ref_nes, f"{p}_sig", "pathway"),
        f"{p}_top": f"""SELECT {on}, pathway, sign(ref_nes) AS ref_sign FROM (SELECT *, row_number() OVER (
            PARTITION BY {on} ORDER BY abs(ref_nes) DESC, pathway) AS rn FROM {ref_nes}) WHERE rn <= 20 AND ref_nes <> 0""",
        f"{p}_dir": f"""SELECT {by}, avg(CASE WHEN sign(nes) = ref_sign THEN 1.0 ELSE 0.0 END) AS dir_concordance
            FROM {cand_nes} JOIN {p}_top USING ({on}, pathway) GROUP BY {by}""",
        f"{p}_conc": f"""SELECT {by}, {r6('g.rho')} AS rho_gene, {r6('jaccard_deg')} AS jaccard_deg,
            {r6('q.rho')} AS rho_pathway, {r6('jaccard_pathway')} AS jaccard_pathway,
            {r6('dir_concordance')} AS dir_concordance FROM {p}_tests LEFT JOIN {p}_rho_gene g USING ({by})
            LEFT JOIN {p}_j_deg USING ({by}) LEFT JOIN {p}_rho_path q USING ({by})
            LEFT JOIN {p}_j_path USING ({by}) LEFT JOIN {p}_dir USING ({by})""",
    }


def vote_sql(src: str, by: str, key: str, col: str, thr: float) -> str:
    """Median and first-significant-sign vote over the reference methods of ``src``."""
    return f"""SELECT {by}, {key}, median({col}) AS ref_{col}, coalesce(
            count(*) FILTER (sg = fs) / any_value(nm) >= 0.75, FALSE) AS voted FROM (
        SELECT *, first_value(sg IGNORE NULLS) OVER (PARTITION BY {by}, {key} ORDER BY ord
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fs FROM (
        SELECT s.*, ord, CASE WHEN abs({col}) > {thr} THEN CAST(sign({col}) AS INTEGER) END AS sg, nm
        FROM {src} s JOIN modes USING (method)
        JOIN (SELECT {by}, count(DISTINCT method) AS nm FROM {src} GROUP BY {by}) USING ({by})))
        GROUP BY {by}, {key}"""


LOOSE = {"fdr": 0.5, "lfc": 0.1, "gene_z": 1.0}  # thresholds of the registered queries: the driver's data has no real effects
VIEWS.update({
    "loso_ref_de": "SELECT * FROM loso_diff WHERE stage = 'reference'",
    "loso_ref_nes": "SELECT * FROM loso_nes WHERE stage = 'reference' AND nes IS NOT NULL",
    "ref_genes": vote_sql("loso_ref_de", "project, srr", "gene", "stat", LOOSE["gene_z"]),
    "ref_paths": vote_sql("loso_ref_nes", "project, srr", "pathway", "nes", 1.0),
    "cand_de": "SELECT * FROM loso_diff WHERE stage = 'candidate'",
    "cand_nes": "SELECT * FROM loso_nes WHERE stage = 'candidate' AND nes IS NOT NULL",
    **concordance_views("e1", "cand_de", "cand_nes", "ref_genes", "ref_paths", "project, srr, method", "project, srr",
                        LOOSE["fdr"], LOOSE["lfc"]),
    "base_de": f"""SELECT project, gene, stat AS ref_stat, padj < {LOOSE['fdr']} AND abs(log2fc) > {LOOSE['lfc']} AS voted
        FROM diff WHERE mode = 'U'""",
    "base_nes": "SELECT project, pathway, nes AS ref_nes, abs(nes) > 1.0 AS voted FROM proj_nes WHERE mode = 'U' AND nes IS NOT NULL",
    "mode_de": "SELECT * FROM diff WHERE mode <> 'U'",
    "mode_nes": "SELECT * FROM proj_nes WHERE mode <> 'U' AND nes IS NOT NULL",
    **concordance_views("e11", "mode_de", "mode_nes", "base_de", "base_nes", "project, mode", "project",
                        LOOSE["fdr"], LOOSE["lfc"]),
})


def variant(suffix: str, root: str, changed: dict[str, str]) -> dict[str, str]:
    """Copies, with ``suffix``, of all views between ``changed`` ones and ``root``."""
    used = lambda text, name: re.search(rf"(?<![\w.'\"]){name}\b(?!['\"(])", text)
    copied = set(changed)
    while more := {n for n, text in VIEWS.items() if n not in copied and any(used(text, c) for c in copied)}:
        copied |= more
    rename = lambda text: re.sub(rf"(?<![\w.'\"])(?<!AS )({'|'.join(sorted(copied, key=len, reverse=True))})\b(?!['\"(])", rf"\1{suffix}", text)
    out = {f"{n}{suffix}": rename(text) for n, text in VIEWS.items() if n in copied and n not in changed}
    return {f"{n}{suffix}": rename(text) for n, text in changed.items()} | out


# Three conditions: control and treatment where both are left in a test, else its first two by name.
PAIR = "(CASE WHEN has(names, 'control') AND has(names, 'treatment') THEN ['control', 'treatment'] ELSE names[1:2] END)".replace("has(", "list_contains(")
VIEWS.update(variant("_c3", "e1_conc", {
    "samples": """SELECT project, srr, CASE WHEN n < 7 THEN names[1] WHEN n < 14 THEN names[2] ELSE names[3] END AS condition
        FROM (SELECT DISTINCT project, srr, CAST(substr(srr, 2) AS INTEGER) AS n,
        CASE WHEN project = 'P1' THEN ['warm', 'cold', 'mild'] ELSE ['control', 'treatment', 'other'] END AS names FROM reads)""",
    "member_sums": f"""SELECT m.project, m.srr, m.stage, m.method, any_value(pair) AS pair,
        CAST(count(*) FILTER (condition = pair[1]) AS DOUBLE) AS n0, CAST(count(*) FILTER (condition = pair[2]) AS DOUBLE) AS n1,
        sum(1 / sf) FILTER (condition = pair[1]) AS r0, sum(1 / sf) FILTER (condition = pair[2]) AS r1
        FROM members m JOIN (SELECT {KEYS}, {PAIR} AS pair FROM (SELECT {KEYS}, list_sort(list(DISTINCT condition)) AS names
            FROM members GROUP BY {KEYS})) p USING ({KEYS})
        GROUP BY ALL HAVING n0 > 0 AND n1 > 0 AND (m.stage = 'candidate' OR count(*) >= 4)""",
    "member_genes": f"""SELECT m.project, m.srr, m.stage, m.method, gene,
        sum("count" / sf) FILTER (condition = pair[1]) AS s0, sum("count" / sf) FILTER (condition = pair[2]) AS s1,
        sum(("count" / sf) * ("count" / sf)) FILTER (condition = pair[1]) AS q0,
        sum(("count" / sf) * ("count" / sf)) FILTER (condition = pair[2]) AS q1
        FROM members m JOIN (SELECT {KEYS}, pair FROM member_sums) p USING ({KEYS})
        JOIN counts c ON c.project = m.project AND c.srr = m.other AND c.mode = m.mode GROUP BY ALL""",
}))


def with_views(query: str) -> str:
    """``query`` behind a WITH clause of every view it needs, directly or through others."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"(?<![\w.'\"]){name}\b(?!['\"(])", text):
                seen.add(name)
                visit(VIEWS[name])
                needed.append(name)

    visit(query)
    if not needed:
        return query
    # A view read more than once is computed once.
    views = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    return views + (",\n" + query[5:] if query.startswith("WITH ") else "\n" + query)
