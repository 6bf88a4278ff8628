"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, importance, mixing, phrases, pii, quality, repeats, rules, sharding, simhash, toxicity, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.minimax_shards(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum_mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("position", F.round(F.get("positions", F.lit(0))).cast("long")).drop("positions")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_rules, op2_warc, op3_sharding, op4_quality, op5_simhash, op6_decontamination, op7_toxicity, op8_repeats, op9_urls, op10_mixing, op11_importance, op12_pii, op13_phrases)}

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCHMARK_WORDS = rf"regexp_extract_all({FOLDED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _time_sql(schedule: tuple[float, ...]) -> str:
    """mixing.time_of in SQL."""
    step = 1.0 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:])]
    done, out = 0.0, ""
    for i, area in enumerate(areas):
        a, slope = schedule[i], (schedule[i + 1] - schedule[i]) / step
        rest = f"greatest(share * {sum(areas)!r}::DOUBLE - {done!r}::DOUBLE, 0::DOUBLE)"
        inside = f"{rest} / {a!r}::DOUBLE" if slope == 0 else f"(sqrt(greatest({a * a!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0::DOUBLE)) - {a!r}::DOUBLE) / {slope!r}::DOUBLE"
        at = f"least({i * step!r}::DOUBLE + {inside}, {(i + 1) * step!r}::DOUBLE)"
        out = at if not out else f"CASE WHEN share * {sum(areas)!r}::DOUBLE >= {done!r}::DOUBLE THEN {at} ELSE {out} END"
        done += area
    return out


ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
        f AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS latest FROM p)
        SELECT page_id, strlen(h)::BIGINT payload_bytes, sha1(h) payload_digest, CASE WHEN latest = page_id THEN 'response' ELSE 'revisit' END record_type,
          CASE WHEN latest <> page_id THEN latest END refers_to FROM f""",
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {BENCHMARK_WORDS} w FROM documents),
        i AS (SELECT item_id, w, least(10, len(w)) n FROM (SELECT item_id, {BENCHMARK_WORDS} w FROM benchmark) WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') k FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) s FROM i)),
        pos AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, s, n, item_id FROM pos JOIN win USING (n, k)),
        hw AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, n_hit IS NOT NULL contaminated
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_repeats": f"""
        WITH d AS (SELECT doc_id, {WORDS} w FROM documents),
        s AS (SELECT doc_id, b, md5(array_to_string(w[b + 1:b + 50], ' ')) k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) b FROM d WHERE len(w) >= 50)),
        g AS (SELECT k, min(doc_id) least_id, max(doc_id) most_id FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
        m AS (SELECT doc_id, b, CASE WHEN doc_id = least_id THEN most_id ELSE least_id END other FROM s JOIN g USING (k)),
        o AS (SELECT *, CASE WHEN b <= lag(b) OVER (PARTITION BY doc_id ORDER BY b) + 50 THEN 0 ELSE 1 END opens FROM m),
        spans AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY b) span FROM o)
        SELECT doc_id, min(b)::INT AS "begin", (max(b) + 50)::INT AS "end", (max(b) + 50 - min(b))::INT n_words, min(other) other_doc_id FROM spans GROUP BY doc_id, span""",
    "op10_mixing": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len({WORDS})::BIGINT size FROM documents),
        r AS (SELECT *, md5(concat_ws(':', doc_id::VARCHAR, size::VARCHAR, '17')) mix FROM d),
        src AS (SELECT source, sum(size)::BIGINT source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM d GROUP BY source),
        wt AS (SELECT *, rk % 3 + 1 weight, 3 * source_size bound FROM src),
        rounds(n, level) AS (
          SELECT 0, (SELECT sum(source_size) / sum(weight) FROM wt)::DOUBLE
          UNION ALL
          SELECT n + 1, (SELECT (sum(source_size) - sum(CASE WHEN weight * level > bound THEN bound ELSE 0 END))::DOUBLE / sum(CASE WHEN weight * level > bound THEN 0 ELSE weight END)::DOUBLE FROM wt) FROM rounds WHERE n < 40),
        lv AS (SELECT level FROM rounds WHERE n = 40),
        tg AS (SELECT source, rk, source_size, CASE WHEN weight * level > bound THEN bound::DOUBLE ELSE weight * level END target FROM wt, lv),
        p AS (SELECT r.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mix, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r),
        j AS (SELECT p.doc_id, p.size, p.start, tg.* FROM p JOIN tg ON p.source IS NOT DISTINCT FROM tg.source),
        c AS (SELECT *, (CASE WHEN size > 0 THEN list_sum(list_transform([0, 1, 2], lambda k: CASE WHEN (start + k * source_size) + size / 2 < target THEN 1 ELSE 0 END)) ELSE 0 END)::INT copies,
              least(CASE WHEN target > 0 THEN start / target END, 1::DOUBLE) share FROM j)
        SELECT doc_id, size, source_size, target, (size * copies)::BIGINT taken, copies,
          CASE WHEN copies > 0 THEN round((CASE rk % 3 WHEN 0 THEN {_time_sql(mixing.CURRICULUM[0])} WHEN 1 THEN {_time_sql(mixing.CURRICULUM[1])} ELSE {_time_sql(mixing.CURRICULUM[2])} END)
            * (SELECT sum(size) FROM d))::BIGINT END AS position FROM c""",
    "op11_importance": f"""
        WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) tab),
        d AS (SELECT doc_id, {BENCHMARK_WORDS} w FROM documents),
        feats AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) g FROM d),
        wanted AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) g FROM (SELECT {BENCHMARK_WORDS} w FROM benchmark)),
        bytes AS (SELECT g, list_transform(range(strlen(g)), lambda i: ((strpos('123456789ABCDEF', hex(g)[2 * i + 1]) * 16) + strpos('123456789ABCDEF', hex(g)[2 * i + 2]))::BIGINT) b FROM (SELECT g FROM feats UNION SELECT g FROM wanted)),
        buckets AS (SELECT g, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) % 10000 k FROM bytes, tab),
        s AS (SELECT k, count(*) n FROM feats JOIN buckets USING (g) GROUP BY k),
        t AS (SELECT k, count(*) n FROM wanted JOIN buckets USING (g) GROUP BY k),
        gain AS (SELECT k, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT gain FROM s LEFT JOIN t USING (k)),
        weights AS (SELECT doc_id, count(*) n, sum(gain)::BIGINT total FROM feats JOIN buckets USING (g) JOIN gain USING (k) GROUP BY doc_id),
        scored AS (SELECT d.doc_id, len(w) n_words, coalesce(n, 0)::BIGINT n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT weight,
          floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT noise FROM d LEFT JOIN weights USING (doc_id)),
        able AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) nth, 25 * count(*) OVER () // 100 quota FROM scored WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN nth <= quota THEN nth END::BIGINT AS rank, n_words::BIGINT n_words FROM scored LEFT JOIN able USING (doc_id)""",
    "op13_phrases": rf"""
        WITH pc AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array({FOLDED}, '[.,;:!?\x0A-\x0D]')) piece FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') w FROM pc),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) i FROM p, (SELECT unnest(range(1, 6)) k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, phrase, count(*) a FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') w FROM f WHERE a >= 100 AND k > 1),
        cuts AS (SELECT c.*, j, array_to_string(w[1:j], ' ') head, array_to_string(w[j + 1:], ' ') tail FROM (SELECT *, unnest(range(1, k)) j FROM c) c),
        s AS (SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, j, x.a l, y.a r, n.n, (1000::HUGEINT * cuts.a * n.n) // (x.a::HUGEINT * y.a) score FROM cuts JOIN n USING (lang)
          JOIN f x ON x.lang = cuts.lang AND x.phrase = head AND x.k = j JOIN f y ON y.lang = cuts.lang AND y.phrase = tail AND y.k = cuts.k - j),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        o AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c y ON y.lang = b.lang AND y.k > b.k AND contains(' ' || y.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * y.a >= 100 * b.a),
        z AS (SELECT * FROM b ANTI JOIN o USING (lang, phrase)),
        t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT a, l::BIGINT l, r::BIGINT r, n, score::BIGINT score FROM t WHERE rank <= 2000""",
}
