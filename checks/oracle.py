"""SQL counterparts of the registered queries, from the source columns alone."""

from __future__ import annotations

# Shared parts: name -> (names it builds on, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLE: dict[str, str] = {}


def part(name: str, *needs: str, sql: str) -> None:
    PARTS[name] = (needs, sql)


def oracle(name: str, *needs: str, sql: str, recursive: bool = False) -> None:
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for m in PARTS[n][0]:
                visit(m)
            order.append(n)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    ORACLE[name] = f"WITH {ctes}\n{sql}" if ctes else sql




def rounded(x: str, digits: int) -> str:
    """Rounding of a double by its decimal text, half away from zero, as Spark does it."""
    return f"round(({x})::VARCHAR::DECIMAL(38, 18), {digits})::DOUBLE"


LINE_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag"
)

part(
    "rx",
    sql=f"""SELECT lineitem.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS position,
      l_orderkey::VARCHAR AS rx_id, p_name || ' ' || p_size AS name
      FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
part(
    "captures",
    sql="""SELECT o_orderkey, o_orderdate, sha256(o_orderkey::VARCHAR) AS hash,
      'run_' || strftime(o_orderdate, '%Y%m') AS pipeline_run_id,
      strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS ingest_date
      FROM orders""",
)
part(
    "parsed",
    "captures",
    "rx",
    sql="""SELECT substr(hash, 1, 12) || '-0' AS line_id, hash AS source_file_hash,
        '' AS drug_name_raw, '' AS drug_name_normalized, NULL::DOUBLE AS dosage_value,
        NULL::VARCHAR AS dosage_unit, NULL::VARCHAR AS frequency, NULL::INTEGER AS quantity,
        0::DOUBLE AS extraction_confidence, pipeline_run_id, ingest_date,
        CASE o_orderkey % 50 WHEN 0 THEN 'unparseable_bronze_json' ELSE 'malformed_payload' END
          AS rejection_reason
      FROM captures WHERE o_orderkey % 50 IN (0, 1)
      UNION ALL
      SELECT substr(hash, 1, 12) || '-' || position, hash,
        CASE WHEN l_orderkey % 50 = 3 THEN ' ' ELSE 'Tab ' || name END,
        CASE WHEN l_orderkey % 50 = 3 THEN ''
          WHEN l_partkey % 8 = 1 THEN substr(name, 1, 6) || substr(name, 8)
          WHEN l_partkey % 8 = 2 THEN upper(name) ELSE name END,
        CASE WHEN l_linenumber % 5 IN (1, 3) THEN
          (l_quantity * CASE WHEN l_partkey % 101 = 0 THEN 10000 ELSE 1 END)::DOUBLE END,
        CASE l_linenumber % 5 WHEN 1 THEN 'mg' WHEN 2 THEN 'ml' WHEN 3 THEN 'mcg' END,
        CASE l_suppkey % 4 WHEN 1 THEN 'BD x ' || l_linenumber || ' days'
          WHEN 2 THEN 'OD × ' || l_linenumber WHEN 3 THEN 'HS' END,
        CASE WHEN l_suppkey % 4 IN (1, 2) THEN l_linenumber END,
        CASE WHEN l_linenumber = 7 THEN 0.5 WHEN l_returnflag = 'A' THEN 0.95
          WHEN l_returnflag = 'N' THEN 0.7 ELSE 0.4 END::DOUBLE,
        pipeline_run_id, ingest_date, NULL
      FROM captures JOIN rx ON l_orderkey = o_orderkey
      WHERE o_orderkey % 50 NOT IN (0, 1, 2)""",
)
part(
    "checked",
    "parsed",
    sql="""SELECT * EXCLUDE (rejection_reason), coalesce(rejection_reason,
      CASE WHEN trim(drug_name_normalized) = '' THEN 'empty_drug_name'
        WHEN dosage_value > 100000 THEN 'dosage_out_of_range' END) AS rejection_reason
      FROM parsed""",
)
part("clean", "checked", sql="SELECT * FROM checked WHERE rejection_reason IS NULL")
part(
    "words",
    sql="""SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
      CASE split_part(p_name, ' ', 1) WHEN 'blue' THEN 'red' WHEN 'cold' THEN 'hot'
        ELSE split_part(p_name, ' ', 1) END AS k1,
      p_size || 'mg' AS s1, ((p_size % 5 + 1) * 10) || 'mg' AS s2 FROM part""",
)
BOTH_SIGNATURE = """CASE WHEN k1 < w2 THEN k1 || '@' || s1 || '|' || w2 || '@' || s2
        ELSE w2 || '@' || s2 || '|' || k1 || '@' || s1 END"""
TITLE1 = "upper(left(k1, 1)) || substr(k1, 2)"
TITLE2 = "upper(left(w2, 1)) || substr(w2, 2)"
BOTH_DISPLAY = f"{TITLE1} || ' (' || s1 || ') + ' || {TITLE2} || ' (' || s2 || ')'"
part(
    "products",
    "words",
    sql=f"""SELECT p_partkey AS pos, p_name || ' ' || p_size || ' Tablet' AS name,
        p_name || ' ' || p_size || ' tablet' AS name_norm, left(p_name, 3) AS block_key,
        CASE WHEN p_type = 'SMALL' THEN {TITLE1} || ' (' || s1 || ')' ELSE {BOTH_DISPLAY} END AS salt,
        CASE WHEN p_type = 'SMALL' THEN [k1] ELSE list_sort([k1, w2]) END AS salt_keys,
        p_brand AS pack, p_retailprice AS price,
        CASE WHEN p_type = 'SMALL' THEN k1 || '@' || s1 ELSE {BOTH_SIGNATURE} END AS signature
      FROM words WHERE p_type <> 'PROMO' AND p_partkey % 97 <> 0 AND p_partkey % 89 <> 0""",
)
part(
    "groups",
    "products",
    sql="""SELECT signature, arg_min(name, row(price, pos)) AS generic_name,
      min(price) AS generic_price, count(*) AS product_count FROM products GROUP BY signature""",
)
part(
    "curated",
    "words",
    sql=f"""SELECT min(p_partkey) AS pos, p_name || '-' || p_size AS brand,
        any_value(w1 || ' ' || s1 || ' + ' || w2 || ' ' || s2) AS salt,
        any_value([w1, w2]) AS salt_keys, arg_min(p_brand, p_partkey) AS category,
        arg_min(p_retailprice, p_partkey) AS brand_price, p_name AS generic_name,
        round(arg_min(p_retailprice, p_partkey) * 0.4::DOUBLE, 2) AS generic_price,
        any_value(list_sort([p_name, w2 || ' ' || w1])) AS aliases,
        any_value({BOTH_SIGNATURE}) AS own_signature, any_value({BOTH_DISPLAY}) AS display,
        any_value(list_sort([k1, w2])) AS keys, p_size
      FROM words WHERE p_type = 'PROMO' GROUP BY p_name, p_size""",
)
part(
    "terms",
    "curated",
    "products",
    sql="""SELECT term, min(row(tier, pos, variant)) AS first FROM (
        SELECT replace(unnest([brand, aliases[1], aliases[2], salt]), '-', ' ') AS term, 0 AS tier,
          pos, unnest([0, 1, 2, 3]) AS variant FROM curated
        UNION ALL SELECT name_norm, 1, pos, 0 FROM products
        UNION ALL SELECT replace(name_norm, ' tablet', ''), 1, pos, 1 FROM products)
      GROUP BY term""",
)
part(
    "term_rows",
    "terms",
    sql="SELECT term, first[1] AS tier, first[2] AS pos, first[3] AS variant FROM terms",
)
part(
    "entries",
    "curated",
    "products",
    "groups",
    sql="""SELECT 0 AS tier, pos, brand, salt, salt_keys, category, '10 tablets' AS pack,
        brand_price, c.generic_name, c.generic_price, 'Jul 2026' AS price_asof,
        g.signature, coalesce(product_count, 0) AS same_salt_brands
      FROM curated c LEFT JOIN groups g ON g.signature = own_signature
      UNION ALL
      SELECT 1, pos, name, salt, salt_keys, 'Medicine', pack, price, generic_name, generic_price,
        'Nov 2022', p.signature, product_count
      FROM products p JOIN groups g USING (signature)""",
)
part(
    "rules",
    "words",
    sql="""SELECT p_name, any_value(w1) AS r1, any_value(w2) AS r2, min(p_partkey) AS rule_pos,
      CASE WHEN (ascii(any_value(w1)) + ascii(any_value(w2))) % 2 = 0 THEN 'major'
        ELSE 'moderate' END AS severity, 'effect of ' || p_name AS effect
      FROM words GROUP BY p_name""",
)
part(
    "baskets",
    "rx",
    "products",
    sql="""SELECT rx_id, l_orderkey, position, products.name AS brand, salt_keys, signature,
      price AS brand_price FROM rx JOIN products ON pos = l_partkey""",
)
part(
    "reps",
    "products",
    sql="""SELECT name_norm, any_value(block_key) AS block_key, min(name) AS name,
      arg_min(price, row(price, pos)) AS price, arg_min(pos, row(price, pos)) AS pos,
      arg_min(salt, row(price, pos)) AS salt, arg_min(signature, row(price, pos)) AS signature
      FROM products GROUP BY name_norm""",
)
part(
    "best",
    "clean",
    "reps",
    sql="""SELECT q, arg_min(row(score, name, salt, price, signature),
        row(-score, gap, name, price, pos)) AS b
      FROM (SELECT q, reps.*, abs(length(q) - length(name_norm)) AS gap,
          floor((greatest(length(q), length(name_norm)) - levenshtein(q, name_norm)) * 100.0
            / greatest(length(q), length(name_norm)))::INTEGER AS score
        FROM (SELECT DISTINCT lower(drug_name_normalized) AS q FROM clean)
        JOIN reps ON block_key = left(q, 3))
      GROUP BY q""",
)
part(
    "matched",
    "clean",
    "best",
    "groups",
    sql="""SELECT line_id, source_file_hash, drug_name_normalized,
        CASE WHEN b[1] >= 60 THEN b[2] END AS matched_product,
        CASE WHEN b[1] >= 60 THEN b[3] END AS matched_salt,
        coalesce(b[1], 0) AS match_score,
        CASE WHEN b[1] >= 100 THEN 'exact' WHEN b[1] >= 60 THEN 'blocked_fuzzy'
          ELSE 'unmatched' END AS match_method,
        CASE WHEN b[1] >= 60 THEN b[4] END AS brand_price,
        CASE WHEN b[1] >= 60 THEN generic_name END AS generic_name,
        CASE WHEN b[1] >= 60 THEN generic_price END AS generic_price,
        CASE WHEN b[1] >= 60 THEN round(b[4] - generic_price, 2) END AS saving,
        pipeline_run_id
      FROM clean LEFT JOIN best ON q = lower(drug_name_normalized)
      LEFT JOIN groups ON groups.signature = b[5]""",
)
part(
    "offices",
    sql="""SELECT c_custkey, lpad((c_custkey % 60)::VARCHAR, 6, '0') AS pincode,
        8 + (c_custkey * 37 % 280) / 10.0 AS lat, 69 + (c_custkey * 53 % 280) / 10.0 AS lng
      FROM customer""",
)
part(
    "centroids",
    "offices",
    sql=f"""SELECT pincode, {rounded('sum(lat::DECIMAL(20, 8))::DOUBLE / count(*)', 5)} AS lat,
        {rounded('sum(lng::DECIMAL(20, 8))::DOUBLE / count(*)', 5)} AS lng
      FROM offices WHERE c_custkey % 23 <> 0 AND c_custkey % 29 <> 0 GROUP BY pincode""",
)
part(
    "all_stores",
    sql="""SELECT lpad(s_suppkey::VARCHAR, 9, '0') AS code, s_name AS name,
        'Road ' || s_suppkey AS address, 'District ' || s_nationkey AS district,
        'State ' || (s_nationkey % 5) AS state,
        lpad((s_suppkey % 70)::VARCHAR, 6, '0') AS pincode FROM supplier""",
)
part(
    "stores",
    "all_stores",
    "centroids",
    sql="SELECT all_stores.*, lat, lng FROM all_stores JOIN centroids USING (pincode)",
)
part(
    "probes",
    sql="""SELECT c_custkey AS probe,
        CASE WHEN c_custkey % 23 = 0 THEN 0 ELSE 8 + (c_custkey * 37 % 280) / 10.0 END::DOUBLE AS lat,
        (69 + (c_custkey * 53 % 280) / 10.0)::DOUBLE AS lng FROM customer""",
)
part(
    "saved_requests",
    sql="""SELECT user_id, user_id * 4 + nth AS id, p_partkey, p_name || ' ' || p_size AS name
      FROM (SELECT c_custkey AS user_id, unnest([0, 1, 2, 3]) AS nth,
        unnest([c_custkey, c_custkey + 211, c_custkey + 409, c_custkey]) AS key FROM customer)
      JOIN part ON p_partkey = key""",
)
part(
    "saved",
    "saved_requests",
    "products",
    sql="""SELECT user_id, products.name AS brand, min(id) AS id, arg_min(salt, id) AS salt,
        arg_min(salt_keys, id) AS salt_keys
      FROM saved_requests JOIN products ON pos = p_partkey GROUP BY user_id, products.name""",
)
DOSE_LEVEL = """SELECT {id} AS id, [{salts}] AS salts, min(p_partkey) * 2 + {offset} AS rule_pos,
        min(p_size) / 2 AS low, max(p_size)::DOUBLE AS high, round(max(p_retailprice), 0) AS cap,
        ascii({id}) % 24 AS months, ({id}) LIKE '%anvil' AS fixed
      FROM words GROUP BY {id}, {salts}"""
part(
    "dose_rules",
    "words",
    sql=DOSE_LEVEL.format(id="w1", salts="w1", offset=0)
    + " UNION ALL "
    + DOSE_LEVEL.format(id="p_name", salts="w1, w2", offset=1),
)
part(
    "patients",
    "words",
    sql="""SELECT c_custkey AS patient, (1 + (c_custkey % 620) / 10.0)::DOUBLE AS weight_kg,
        [w1, w2] AS salt_keys FROM customer JOIN words ON p_partkey = c_custkey""",
)
part(
    "dosed",
    "patients",
    "dose_rules",
    sql="""SELECT patient, weight_kg, arg_max(id, row(len(salts), -rule_pos)) AS rule_id
      FROM patients JOIN dose_rules ON list_has_all(salt_keys, salts) GROUP BY patient, weight_kg""",
)
part("runs", "captures", sql="""SELECT pipeline_run_id,
        strftime(min(o_orderdate), '%Y-%m-%d') AS run_started_at,
        strftime(max(o_orderdate), '%Y-%m-%d') AS run_finished_at, count(*)::INTEGER AS bronze_rows
      FROM captures GROUP BY pipeline_run_id""")
part(
    "metrics",
    "runs",
    "checked",
    "matched",
    sql=f"""SELECT pipeline_run_id, run_started_at, run_finished_at, bronze_rows,
        coalesce(silver_rows, 0)::INTEGER AS silver_rows,
        coalesce(quarantine_rows, 0)::INTEGER AS quarantine_rows,
        coalesce(gold_rows, 0)::INTEGER AS gold_rows,
        coalesce(matched_rows, 0)::INTEGER AS matched_rows,
        coalesce(match_rate, 0) AS match_rate, coalesce(mean_confidence, 0) AS mean_confidence,
        'match=1.5' AS stage_durations_sec, 'success' AS status,
        coalesce(reasons, CASE WHEN silver_rows IS NULL THEN 'zero_rows=1' ELSE '' END)
          AS validation_failures
      FROM runs
      LEFT JOIN (SELECT pipeline_run_id, count(*) AS silver_rows,
          {rounded('sum(extraction_confidence::DECIMAL(9, 6))::DOUBLE / count(*)', 4)}
            AS mean_confidence
        FROM checked WHERE rejection_reason IS NULL GROUP BY 1) USING (pipeline_run_id)
      LEFT JOIN (SELECT pipeline_run_id, sum(n) AS quarantine_rows,
          string_agg(rejection_reason || '=' || n, ',' ORDER BY rejection_reason) AS reasons
        FROM (SELECT pipeline_run_id, rejection_reason, count(*) AS n FROM checked
          WHERE rejection_reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (pipeline_run_id)
      LEFT JOIN (SELECT pipeline_run_id, count(*) AS gold_rows,
          count(*) FILTER (match_method <> 'unmatched') AS matched_rows,
          {rounded("count(*) FILTER (match_method <> 'unmatched') / count(*)", 4)} AS match_rate
        FROM matched GROUP BY 1) USING (pipeline_run_id)""",
)

LINES = """line_id, source_file_hash, drug_name_raw, drug_name_normalized, dosage_value, dosage_unit,
  frequency, quantity, extraction_confidence, pipeline_run_id"""

oracle("parse_lines", "parsed", sql=f"SELECT {LINES}, rejection_reason FROM parsed")
oracle(
    "validate_lines",
    "checked",
    sql="SELECT line_id, source_file_hash, rejection_reason FROM checked",
)
oracle(
    "quarantine_summary",
    "checked",
    sql="""SELECT pipeline_run_id, rejection_reason, count(*) AS failures FROM checked
      WHERE rejection_reason IS NOT NULL GROUP BY ALL""",
)
oracle(
    "failure_summary",
    "checked",
    sql="""SELECT string_agg(rejection_reason || '=' || n, ',' ORDER BY rejection_reason)
      AS validation_failures FROM (SELECT rejection_reason, count(*) AS n FROM checked
      WHERE rejection_reason IS NOT NULL GROUP BY 1)""",
)
oracle(
    "prescription_gate",
    "captures",
    sql="""SELECT pipeline_run_id, count(*) AS captures FROM captures
      WHERE o_orderkey % 50 NOT IN (0, 1, 2) GROUP BY 1""",
)
oracle(
    "catalogue_import",
    "products",
    sql="""SELECT pos, name, name_norm, block_key, salt, array_to_string(salt_keys, ',') AS salt_keys,
      pack, price, signature FROM products""",
)
oracle("signature_groups", "groups", sql="SELECT * FROM groups")
oracle(
    "composition_parts",
    "curated",
    sql="""SELECT pos, own_signature AS signature, display, array_to_string(keys, ',') AS keys
      FROM curated""",
)
oracle(
    "curated_merge",
    "curated",
    sql="""SELECT brand, category, brand_price, array_to_string(aliases, ';') AS aliases,
      row_number() OVER (PARTITION BY category ORDER BY brand, brand_price) AS category_rank FROM curated""",
)
oracle(
    "rule_merge",
    "rules",
    sql="""SELECT CASE severity WHEN 'major' THEN r1 || ',' || r2 ELSE r2 || ',' || r1 END AS salts,
      severity, CASE severity WHEN 'major' THEN effect ELSE 'again: ' || effect END AS effect
      FROM rules""",
)
oracle("alias_terms", "curated", sql="SELECT brand, unnest(aliases) AS alias FROM curated")
oracle(
    "silver_upsert",
    sql="""SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
        l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC,
        l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""",
)
oracle(
    "last_wins",
    sql="""SELECT user_id, event_type, event_id FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
oracle(
    "layer_roundtrip",
    "captures",
    sql="""SELECT pipeline_run_id, hash AS source_file_hash, ingest_date FROM captures
      WHERE pipeline_run_id = 'run_199703'
      UNION ALL SELECT pipeline_run_id, hash, ingest_date FROM captures
      WHERE ingest_date BETWEEN '1998-01-01' AND '1998-06-30'""",
)
oracle("replay_lines", "clean", sql=f"SELECT {LINES} FROM clean")
oracle("incremental_refine", "clean", sql=f"SELECT {LINES} FROM clean")
oracle(
    "backfill_window",
    "clean",
    sql=f"SELECT {LINES} FROM clean WHERE ingest_date BETWEEN '1997-01-01' AND '1997-06-30'",
)
oracle(
    "quarantine_view",
    "checked",
    sql="""SELECT pipeline_run_id, line_id, rejection_reason FROM checked
      WHERE rejection_reason IS NOT NULL""",
)
oracle(
    "retried_quarantine",
    "checked",
    sql="""SELECT pipeline_run_id, line_id, rejection_reason FROM checked
      WHERE rejection_reason IS NOT NULL""",
)
oracle("gold_upsert", "matched", sql="SELECT * FROM matched")
oracle(
    "serving_snapshot",
    "matched",
    sql="""SELECT pipeline_run_id, match_method, count(*) AS lines,
      count(DISTINCT line_id) AS line_ids FROM matched GROUP BY ALL""",
)
oracle(
    "landing_hash",
    sql="""SELECT 'run_1' AS pipeline_run_id, sha256(text) AS source_file_hash,
      'scan_' || doc_id || '.JPG' AS source_path, 'image/jpeg' AS media_type,
      strlen(text) AS size_bytes, '2026-01-01' AS ingest_date FROM documents""",
)
for name in ("landing_scan", "incremental_landing"):
    oracle(
        name,
        sql="""SELECT 'image/png' AS media_type, sum(2 * strlen(text) + 1)::BIGINT AS bytes,
          true AS no_repeats FROM documents""",
    )
oracle("term_index", "term_rows", sql="SELECT * FROM term_rows")
oracle(
    "search_names",
    "curated",
    "products",
    sql="""SELECT replace(brand, '-', ' ') AS name_norm, brand AS display FROM curated
      UNION SELECT name_norm, name FROM products""",
)
oracle(
    "exact_match",
    "clean",
    "term_rows",
    sql="""SELECT line_id, term, tier, pos FROM clean
      JOIN term_rows ON term = lower(drug_name_normalized)""",
)
oracle(
    "generic_enrich",
    "products",
    "groups",
    sql="""SELECT pos, name, generic_name, generic_price, product_count,
      round(price - generic_price, 2) AS saving,
      round_even((price - generic_price) / price * 100, 0)::INTEGER AS saving_pct
      FROM products JOIN groups USING (signature)""",
)
oracle(
    "curated_signature_link",
    "curated",
    "groups",
    sql="""SELECT pos, brand, signature, product_count FROM curated
      LEFT JOIN groups ON signature = own_signature""",
)
oracle(
    "all_entries",
    "entries",
    sql="SELECT * REPLACE (array_to_string(salt_keys, ',') AS salt_keys) FROM entries",
)
oracle("fuzzy_match_levenshtein", "matched", sql="SELECT * FROM matched")
oracle(
    "unmatched_report",
    "matched",
    sql="""SELECT drug_name_normalized, count(*) AS lines, max(match_score) AS best_score
      FROM matched WHERE match_method = 'unmatched' GROUP BY 1""",
)
EDIT = "(greatest(length(q), length(term)) - levenshtein(q, term)) * 100.0 / greatest(length(q), length(term))"
part(
    "asked",
    "clean",
    sql="""SELECT DISTINCT lower(unnest([drug_name_normalized, replace(drug_name_raw, 'Tab ', '')])) AS q FROM clean""",
)
part(
    "tiers",
    "asked",
    "term_rows",
    sql=f"""SELECT q, CASE WHEN e.term IS NOT NULL THEN row(e.tier, e.pos, 100)
        WHEN b[3] >= coalesce(c[3], 0) THEN b ELSE c END AS hit
      FROM asked LEFT JOIN term_rows e ON e.term = q
      LEFT JOIN (SELECT q, arg_min(row(tier, pos, floor(s)::INTEGER), row(-s, tier, pos, variant)) AS c FROM (
        SELECT q, tier, pos, variant, {EDIT} AS s FROM asked JOIN term_rows ON tier = 0) WHERE s >= 72 GROUP BY q) USING (q)
      LEFT JOIN (SELECT q, arg_min(row(tier, pos, floor(s)::INTEGER), row(-s, tier, pos, variant)) AS b FROM (
        SELECT q, tier, pos, variant, {EDIT} AS s FROM asked JOIN term_rows ON left(term, 3) = left(q, 3)
        WHERE length(q) >= 3) WHERE s >= 85 GROUP BY q) USING (q)""",
)
oracle(
    "tiered_match_edit",
    "clean",
    "tiers",
    sql="""SELECT line_id, drug_name_normalized AS name, hit[1] AS tier, hit[2] AS pos, coalesce(hit[3], 0) AS match_score
      FROM clean JOIN tiers ON q = lower(drug_name_normalized)""",
)
oracle(
    "best_of_two_edit",
    "clean",
    "tiers",
    sql="""SELECT line_id, drug_name_raw, drug_name_normalized, h[1] AS tier, h[2] AS pos, coalesce(h[3], 0) AS match_score
      FROM (SELECT clean.*, CASE WHEN r.hit[3] > coalesce(i.hit[3], 0) THEN r.hit ELSE i.hit END AS h
        FROM clean JOIN tiers i ON i.q = lower(drug_name_normalized)
        JOIN tiers r ON r.q = lower(replace(drug_name_raw, 'Tab ', '')))""",
)
DRAW = "('0x' || substr(md5('{seed}|' || copy || '|' || pos), 1, 8))::BIGINT"
oracle(
    "noisy_names",
    "products",
    sql=f"""SELECT 'bench-' || pos || '-' || copy AS line_id, name,
      CASE WHEN length(name) >= 5 AND {DRAW.format(seed=9)} % 2 = 0
        THEN substr(name, 1, 1 + ({DRAW.format(seed=8)} % (length(name) - 2))::INTEGER)
          || substr(name, 3 + ({DRAW.format(seed=8)} % (length(name) - 2))::INTEGER)
        ELSE name END AS noisy
      FROM (SELECT pos, name, unnest([0, 1]) AS copy FROM products)
      QUALIFY row_number() OVER (ORDER BY copy, {DRAW.format(seed=7)}, pos)
        <= (SELECT 3 * count(*) // 2 FROM products)""",
)
part(
    "cheap",
    "products",
    sql="""SELECT signature, lower(name) AS name_key, arg_min(name, row(price, pos)) AS alt,
      min(price) AS alt_price, arg_min(pack, row(price, pos)) AS alt_pack,
      arg_min(pos, row(price, pos)) AS alt_pos FROM products GROUP BY 1, 2""",
)
oracle(
    "alternatives_topk",
    "products",
    "cheap",
    sql="""SELECT pos, nth, brand, price, pack FROM (
        SELECT pos, alt AS brand, alt_price AS price, alt_pack AS pack,
          row_number() OVER (PARTITION BY pos ORDER BY alt_price, alt_pos) - 1 AS nth
        FROM products JOIN cheap USING (signature) WHERE name_key <> lower(name)) WHERE nth < 5""",
)
oracle(
    "prefix_suggest",
    "curated",
    "products",
    "term_rows",
    "entries",
    sql="""SELECT query, rank, brand AS name, salt, brand_price AS price, pack FROM (
        SELECT query, name_norm, row_number() OVER (PARTITION BY query ORDER BY name_norm, display)
          AS rank
        FROM (SELECT DISTINCT upper(left(p_name || ' ' || p_size, n)) AS query
          FROM part, (SELECT unnest([1, 3, 6, 40]) AS n))
        JOIN (SELECT replace(brand, '-', ' ') AS name_norm, brand AS display FROM curated
          UNION SELECT name_norm, name FROM products)
          ON starts_with(name_norm, trim(lower(query))))
      JOIN term_rows ON term = name_norm JOIN entries USING (tier, pos) WHERE rank <= 8""",
)
oracle(
    "medicine_detail",
    "products",
    "term_rows",
    "entries",
    "cheap",
    sql="""SELECT n.name, brand, salt, category, brand_price, generic_name, generic_price, price_asof,
        same_salt_brands, 100 AS match_score,
        coalesce((SELECT string_agg(alt, ';' ORDER BY alt_price, alt_pos) FROM (
          SELECT * FROM cheap WHERE cheap.signature = e.signature AND name_key <> lower(e.brand)
          ORDER BY alt_price, alt_pos LIMIT 30)), '') AS alternatives,
        (SELECT string_agg(upper(left(k, 1)) || substr(k, 2) || '=' || uses, ';' ORDER BY k)
          FROM (SELECT unnest(e.salt_keys) AS k) JOIN (SELECT split_part(p_name, ' ', 2) AS k,
            max(p_size) AS uses FROM part GROUP BY 1) USING (k)) AS salt_info
      FROM (SELECT DISTINCT name FROM products) n JOIN term_rows ON term = lower(n.name)
      JOIN entries e USING (tier, pos)""",
)
PAIR_RULES = """(list_contains(a.salt_keys, r1) AND list_contains({b}, r2))
        OR (list_contains({b}, r1) AND list_contains(a.salt_keys, r2))"""
DUPLICATE = """'Both contain ' || upper(left(s, 1)) || substr(s, 2)
        || ' — taking them together risks an accidental overdose of that ingredient.'"""
oracle(
    "interaction_pairs",
    "baskets",
    "rules",
    sql=f"""SELECT *, row_number() OVER (PARTITION BY rx_id ORDER BY severity <> 'major', pos_a, pos_b, rule_pos,
        effect, brand_a, brand_b) AS warning_rank FROM (
      SELECT rx_id, brand_a, brand_b, rule_pos, severity, effect, min(pos_a) AS pos_a, min(pos_b) AS pos_b FROM (
        SELECT a.rx_id, a.brand AS brand_a, b.brand AS brand_b, rule_pos, severity, effect,
          a.position AS pos_a, b.position AS pos_b
        FROM baskets a JOIN baskets b ON a.rx_id = b.rx_id AND a.position < b.position
        JOIN rules ON {PAIR_RULES.format(b='b.salt_keys')}
        UNION ALL
        SELECT rx_id, brand_a, brand_b, -1, 'moderate', {DUPLICATE}, pos_a, pos_b FROM (
          SELECT a.rx_id, a.brand AS brand_a, b.brand AS brand_b, a.position AS pos_a, b.position AS pos_b,
            unnest(list_filter(list_intersect(a.salt_keys, b.salt_keys), lambda x: x <> 'gear')) AS s
          FROM baskets a JOIN baskets b ON a.rx_id = b.rx_id AND a.position < b.position))
      GROUP BY ALL)""",
)
oracle(
    "cross_interactions",
    "baskets",
    "saved",
    "rules",
    sql=f"""SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY severity <> 'major', pos_a, rule_pos, effect,
        brand_a, saved_med) AS warning_rank FROM (SELECT scan_id, user_id, brand_a, saved_med, rule_pos, severity, effect,
        min(pos_a) AS pos_a FROM (
        SELECT a.rx_id AS scan_id, user_id, a.brand AS brand_a, saved.brand AS saved_med, rule_pos,
          severity, effect, a.position AS pos_a
        FROM baskets a JOIN orders ON o_orderkey = l_orderkey JOIN saved ON user_id = o_custkey
        JOIN rules ON {PAIR_RULES.format(b='saved.salt_keys')}
        WHERE lower(a.brand) <> lower(saved.brand)
        UNION ALL
        SELECT rx_id, user_id, brand_a, saved_med, -1, 'moderate', {DUPLICATE}, pos_a FROM (
          SELECT a.rx_id, user_id, a.brand AS brand_a, saved.brand AS saved_med,
            a.position AS pos_a, unnest(list_filter(list_intersect(a.salt_keys, saved.salt_keys),
              lambda x: x <> 'gear')) AS s
          FROM baskets a JOIN orders ON o_orderkey = l_orderkey JOIN saved ON user_id = o_custkey
          WHERE lower(a.brand) <> lower(saved.brand)))
      GROUP BY ALL)""",
)
oracle(
    "basket_totals",
    "baskets",
    "groups",
    sql="""SELECT rx_id, brand, generic, round(brand - generic, 2) AS saving,
        round_even((brand - generic) / brand * 100, 0)::INTEGER AS saving_pct FROM (
        SELECT rx_id, sum(brand_price::DECIMAL(18, 2))::DOUBLE AS brand,
          sum(generic_price::DECIMAL(18, 2))::DOUBLE AS generic
        FROM baskets JOIN groups USING (signature) GROUP BY rx_id)""",
)
oracle("pincode_centroid", "centroids", sql="SELECT * FROM centroids")
oracle("store_build", "stores", sql="SELECT * FROM stores")
oracle(
    "store_build_report",
    "all_stores",
    "centroids",
    sql="""SELECT count(c.pincode) AS located, count(*) - count(c.pincode) AS skipped,
      (SELECT count(*) FROM centroids) AS centroids
      FROM all_stores s LEFT JOIN centroids c ON c.pincode = s.pincode""",
)
oracle(
    "pincode_resolve",
    "stores",
    sql="""SELECT c_custkey AS probe, pincode, lat, lng FROM customer
      JOIN (SELECT DISTINCT pincode, lat, lng FROM stores)
      ON pincode = lpad((c_custkey % 80)::VARCHAR, 6, '0')""",
)
KM = """2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
        + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))"""
oracle(
    "nearest_stores",
    "stores",
    "probes",
    sql=f"""SELECT probe, rank, code, {rounded('km', 1)} AS distance_km,
        'https://www.google.com/maps/search/?api=1&query='
          || replace('Generic Store ' || address || ' ' || district || ' ' || pincode, ' ', '+')
          AS maps_url
      FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY km, code) AS rank FROM (
        SELECT probe, stores.* EXCLUDE (lat, lng),
          {rounded(KM.format(a='probes', b='stores'), 9)} AS km
        FROM probes CROSS JOIN stores))
      WHERE rank <= 5""",
)
oracle(
    "store_distance",
    "probes",
    "centroids",
    sql=f"""SELECT probe, {rounded(KM.format(a='probes', b='centroids'), 3)} AS km
      FROM probes JOIN centroids ON pincode = lpad((probe % 60)::VARCHAR, 6, '0')""",
)
oracle("dose_rules", "dose_rules", sql="SELECT id, 'Label of ' || id AS label FROM dose_rules")
oracle("dose_rule_match", "dosed", sql="SELECT patient, rule_id FROM dosed")
ML = """(round_even({x} / {c} / CASE WHEN {x} / {c} < 5 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END, 0)
        * CASE WHEN {x} / {c} < 5 THEN 25 ELSE 50 END)::INTEGER"""


def _syrup(label: str, c: str) -> str:
    return f"'{label}:' || {ML.format(x='lo', c=c)} || ':' || {ML.format(x='hi', c=c)}"


oracle(
    "dose_table",
    "dosed",
    "dose_rules",
    sql=f"""SELECT patient, weight_kg, rule_id, CASE WHEN ok THEN 'Label of ' || rule_id END AS label,
        CASE WHEN ok THEN {rounded('lo', 1)} END AS dose_mg_low,
        CASE WHEN ok THEN {rounded('hi', 1)} END AS dose_mg_high,
        ok AND coalesce(high * weight_kg > cap AND NOT fixed, false) AS capped,
        CASE WHEN ok THEN concat_ws('|',
          CASE WHEN months > 0 THEN 'Not for children below ' || CASE WHEN months >= 12
            THEN (months // 12) || ' year(s)' ELSE months || ' month(s)' END
            || ' without a doctor''s advice.' END,
          CASE WHEN high * weight_kg > cap AND NOT fixed THEN 'Dose capped at the child maximum of '
            || cap::BIGINT || ' mg per dose.' END) END AS cautions,
        CASE WHEN ok THEN {_syrup('Drops', '100')} || '|' || {_syrup('Syrup', '24')} END AS syrups,
        CASE WHEN ok AND fixed THEN 1 END AS fixed_doses,
        CASE WHEN NOT ok THEN 'Weight must be between 2.5 and 60.0 kg. For newborns or larger '
          || 'children/adults, ask a doctor directly.' END AS error
      FROM (SELECT *, weight_kg BETWEEN 2.5 AND 60 AS ok,
          CASE WHEN NOT fixed THEN least(low * weight_kg, cap) END AS lo,
          CASE WHEN NOT fixed THEN least(high * weight_kg, cap) END AS hi
        FROM dosed JOIN dose_rules ON id = rule_id)""",
)
oracle(
    "match_stats",
    "matched",
    sql=f"""SELECT count(*) AS gold_rows, count(*) FILTER (match_method <> 'unmatched')
      AS matched_rows, {rounded("count(*) FILTER (match_method <> 'unmatched') / count(*)", 4)}
      AS match_rate FROM matched""",
)
oracle("run_metrics", "metrics", sql="SELECT * FROM metrics")
oracle(
    "metrics_mirror",
    "metrics",
    sql="""SELECT pipeline_run_id, silver_rows, '{"match":1.5}' AS stage_durations_sec,
      2 AS history_rows FROM metrics""",
)
oracle(
    "run_health",
    "metrics",
    "matched",
    sql=f"""SELECT 'ok' AS status, NULL::VARCHAR AS detail, pipeline_run_id AS last_run_id,
        run_finished_at AS last_run_at, (SELECT count(*) FROM metrics) AS total_runs, match_rate,
        mean_confidence, bronze_rows, silver_rows, quarantine_rows, gold_rows, matched_rows,
        coalesce({rounded('quarantine_rows / nullif(silver_rows + quarantine_rows, 0)', 4)}, 0)
          AS quarantine_rate, validation_failures, stage_durations_sec,
        (SELECT count(*) FROM matched) AS served_prescription_lines
      FROM metrics ORDER BY run_finished_at DESC, pipeline_run_id DESC LIMIT 1""",
)
oracle(
    "layer_reconcile",
    "captures",
    "checked",
    "matched",
    sql="""SELECT pipeline_run_id, max(b) AS bronze_rows, max(s) AS silver_rows,
        max(q) AS quarantine_rows, max(g) AS gold_rows FROM (
        SELECT pipeline_run_id, count(*) AS b, 0 AS s, 0 AS q, 0 AS g FROM captures GROUP BY 1
        UNION ALL SELECT pipeline_run_id, 0, 0, 0, count(*) FROM matched GROUP BY 1
        UNION ALL SELECT pipeline_run_id, 0, count(*) FILTER (rejection_reason IS NULL),
          count(*) FILTER (rejection_reason IS NOT NULL), 0 FROM checked GROUP BY 1)
      GROUP BY 1""",
)
oracle(
    "row_count_trend",
    "runs",
    "clean",
    sql=f"""SELECT pipeline_run_id, silver_rows, {rounded("""avg(silver_rows) OVER (
        ORDER BY run_finished_at, pipeline_run_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""", 4)}
        AS trailing_average
      FROM (SELECT pipeline_run_id, any_value(run_finished_at) AS run_finished_at,
          count(*) AS silver_rows FROM runs JOIN clean USING (pipeline_run_id) GROUP BY 1)""",
)
oracle(
    "feedback_stats",
    sql="""SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS correct,
      count(*) FILTER (event_type = 'error') AS wrong,
      round_even(count(*) FILTER (event_type <> 'error') / count(*) * 100, 0)::INTEGER AS accuracy_pct
      FROM events""",
)
oracle(
    "most_corrected",
    sql="""SELECT 'brand_' || (user_id % 40) AS brand, count(*) AS count FROM events
      WHERE event_type = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
oracle(
    "lifetime_saving",
    sql="""SELECT o_custkey AS user_id, coalesce(sum(o_totalprice::DECIMAL(18, 2))
      FILTER (o_orderkey % 17 <> 0), 0)::DOUBLE AS total_saving FROM orders GROUP BY 1""",
)
oracle(
    "scan_history",
    sql="""SELECT o_orderkey AS id, o_custkey AS user_id, 'scan' AS source,
        epoch(o_orderdate)::BIGINT AS created_at, o_orderpriority || '|q' || o_custkey AS medicines,
        CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice ELSE 0 END AS saving,
        (o_orderkey % 4)::INTEGER AS warnings
      FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 5""",
)
oracle("saved_medicines", "saved", sql="""SELECT user_id, brand, id, salt,
    row_number() OVER (PARTITION BY user_id ORDER BY brand) AS brand_rank FROM saved""")
ORACLE["quota_admission"] = """WITH RECURSIVE e AS (
    SELECT event_id, user_id AS client, epoch_us(ts) AS moment,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  r AS (
    SELECT event_id, client, moment, rn, true AS admitted, [moment] AS recent FROM e WHERE rn = 1
    UNION ALL
    SELECT event_id, client, moment, rn, len(live) < 2,
      CASE WHEN len(live) < 2 THEN list_append(live, moment) ELSE live END
    FROM (SELECT e.*, list_filter(r.recent, lambda x: x >= e.moment - 86400000000) AS live
      FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1))
  SELECT event_id, client, admitted FROM r"""
ORACLE["quota_stream"] = ORACLE["quota_admission"]
