"""Claims, statements and party assertions derived from the star-schema tables, by SQL that Spark and DuckDB both run.

A view is a SELECT with {table} for stored tables and plain names for other views. with_views() strings the needed ones
together as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels")

#: The moment that current scopes are judged against.
NOW = "2024-01-15T00:00:00"

VIEWS = {
    "raw_claims": """
        SELECT o_orderkey AS claim_id,
          CASE o_orderkey % 9 WHEN 0 THEN 'I' WHEN 1 THEN ' My ' WHEN 2 THEN '' WHEN 3 THEN 'the ' || c_name WHEN 4 THEN 'event_' || CAST(o_orderkey AS STRING)
            WHEN 5 THEN NULL ELSE c_name END AS subject,
          CASE o_orderkey % 8 WHEN 0 THEN 'is located in the' WHEN 1 THEN 'Has Population' WHEN 2 THEN 'was_born in' WHEN 3 THEN ' pays: for  a '
            WHEN 4 THEN 'greater_than' WHEN 5 THEN 'is' WHEN 6 THEN 'located_in' ELSE '  ' END AS predicate,
          CASE o_orderkey % 11 WHEN 0 THEN n_name WHEN 1 THEN '1,234 units' WHEN 2 THEN '1.5 million' WHEN 3 THEN 'a town in ' || n_name
            WHEN 4 THEN 'some river that borders ' || n_name WHEN 5 THEN CAST(o_orderkey AS STRING) WHEN 6 THEN 'c. 1997' WHEN 7 THEN NULL
            WHEN 8 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 9 THEN c_name ELSE 'green ink' END AS object,
          CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS polarity,
          CASE o_orderkey % 7 WHEN 0 THEN 'future' WHEN 1 THEN 'past' ELSE 'present' END AS verb_tense,
          CASE WHEN o_orderkey % 6 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS valid_from,
          CASE WHEN o_orderkey % 10 = 3 THEN '1999-12' END AS valid_until,
          CASE WHEN o_orderkey % 13 = 4 THEN 'claim_' || CAST(o_orderkey - 1 AS STRING) END AS valid_during_ref,
          CASE WHEN o_orderkey % 4 = 0 THEN c_name || ' lives in ' || n_name WHEN o_orderkey % 4 = 1 THEN '' ELSE n_name || ' has ' || c_name END AS source_text,
          'user_' || CAST(o_custkey % 50 AS STRING) AS party
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey""",
    "kb_edges": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS src, 'P17' AS property, 'N' || CAST(c_nationkey AS STRING) AS dst FROM {customer}
        UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'P17', 'N' || CAST(s_nationkey AS STRING) FROM {supplier}
        UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'P30', 'R' || CAST(n_regionkey AS STRING) FROM {nation}
        UNION ALL SELECT 'PT' || CAST(p_partkey AS STRING), 'P31', 'B' || substring(p_brand, 7, 9) FROM {part}
        UNION ALL SELECT DISTINCT 'B' || substring(p_brand, 7, 9), 'P279', 'K' || CAST(CAST(substring(p_brand, 7, 9) AS INT) % 5 AS STRING) FROM {part}
        UNION ALL SELECT DISTINCT 'K' || CAST(CAST(substring(p_brand, 7, 9) AS INT) % 5 AS STRING), 'P279', 'ROOT' FROM {part}
        UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'P31', 'country' FROM {nation}
        UNION ALL SELECT 'R' || CAST(r_regionkey AS STRING), 'P31', 'continent' FROM {region}
        UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'P361', 'U' || CAST(n_nationkey % 4 AS STRING) FROM {nation} WHERE n_nationkey % 3 <> 0
        UNION ALL SELECT DISTINCT 'U' || CAST(n_nationkey % 4 AS STRING), 'P31', CASE n_nationkey % 4 WHEN 3 THEN 'treaty' ELSE 'union' END FROM {nation}
        UNION ALL SELECT 'country', 'P279', 'place' UNION ALL SELECT 'continent', 'P279', 'place' UNION ALL SELECT 'union', 'P279', 'place'""",
    "kb_labels": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS kb_id, c_name AS label FROM {customer}
        UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), s_name FROM {supplier}
        UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), n_name FROM {nation}
        UNION ALL SELECT 'R' || CAST(r_regionkey AS STRING), r_name FROM {region}
        UNION ALL SELECT 'PT' || CAST(p_partkey AS STRING), p_name FROM {part}
        UNION ALL SELECT DISTINCT 'U' || CAST(n_nationkey % 4 AS STRING), 'Union ' || CAST(n_nationkey % 4 AS STRING) FROM {nation}""",
    "kb_statements": """
        SELECT c_custkey * 10 AS stmt_id, 'C' || CAST(c_custkey AS STRING) AS entity, 'P17' AS property, 'N' || CAST(c_nationkey AS STRING) AS value, 'entity' AS value_type,
          CASE c_custkey % 7 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'preferred' ELSE 'normal' END AS rank,
          CASE WHEN c_custkey % 3 = 0 THEN CAST(1990 + c_custkey % 20 AS STRING) || '-03-05' END AS start_q,
          CASE WHEN c_custkey % 24 IN (0, 19) THEN CAST(2012 + c_custkey % 9 AS STRING) || '-10-01' END AS end_q
        FROM {customer}
        UNION ALL SELECT c_custkey * 10 + 1, 'C' || CAST(c_custkey AS STRING), 'P17', 'N' || CAST((c_nationkey + 1) % 25 AS STRING), 'entity', 'normal',
          CASE WHEN c_custkey % 4 = 0 THEN '2001' END, CASE WHEN c_custkey % 8 = 0 THEN '2009-06' END
        FROM {customer} WHERE c_custkey % 11 = 0
        UNION ALL SELECT c_custkey * 10 + 2, 'C' || CAST(c_custkey AS STRING), 'P17', 'Somewhere in text', 'literal', 'normal', NULL, NULL FROM {customer} WHERE c_custkey % 14 = 7
        UNION ALL SELECT c_custkey * 10 + 3, 'C' || CAST(c_custkey AS STRING), 'P17', '1999-01-01', 'date', 'normal', NULL, NULL FROM {customer} WHERE c_custkey % 28 = 14
        UNION ALL SELECT s_suppkey * 10 + 8000000001, 'S' || CAST(s_suppkey AS STRING), 'P131', 'N' || CAST(s_nationkey AS STRING), 'entity', 'normal', NULL, NULL FROM {supplier} WHERE s_suppkey % 5 <> 0
        UNION ALL SELECT o_orderkey * 10 + 5000000002, 'O' || CAST(o_orderkey AS STRING), 'P585', CAST(CAST(o_orderdate AS DATE) AS STRING), 'date',
          CASE o_orderkey % 7 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'preferred' ELSE 'normal' END, NULL, NULL
        FROM {orders}
        UNION ALL SELECT o_orderkey * 10 + 5000000003, 'O' || CAST(o_orderkey AS STRING), 'P2284', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), 'quantity',
          CASE o_orderkey % 5 WHEN 0 THEN 'preferred' ELSE 'normal' END, NULL, NULL
        FROM {orders}
        UNION ALL SELECT o_orderkey * 10 + 5000000004, 'O' || CAST(o_orderkey AS STRING), 'P2284', CAST(CAST(floor(o_totalprice) AS BIGINT) + 700 AS STRING), 'quantity', 'normal', NULL, NULL
        FROM {orders} WHERE o_orderkey % 6 = 1""",
    "predicates": """
        SELECT 'located_in' AS predicate, 'P17' AS property, 'entity' AS object_type, 'kb_resolvable' AS routing_hint, true AS single_valued, true AS is_location, false AS user_subject, 1 AS id
        UNION ALL SELECT 'based_in', 'P17', 'entity', 'kb_resolvable', false, true, false, 2
        UNION ALL SELECT 'ordered_on', 'P585', 'time', 'kb_resolvable', true, false, false, 3
        UNION ALL SELECT 'priced_above', 'P2284', 'quantity', 'kb_quantitative', true, false, false, 4
        UNION ALL SELECT 'priced_below', 'P2284', 'quantity', 'kb_quantitative', true, false, false, 5
        UNION ALL SELECT 'prefers', CAST(NULL AS STRING), 'entity', 'user_authoritative', true, false, true, 6
        UNION ALL SELECT 'click', CAST(NULL AS STRING), 'entity', 'user_authoritative', true, false, false, 7
        UNION ALL SELECT 'view', CAST(NULL AS STRING), 'entity', 'user_authoritative', false, false, false, 8
        UNION ALL SELECT 'contains', CAST(NULL AS STRING), 'entity', 'kb_resolvable', false, false, false, 9
        UNION ALL SELECT 'ships_from', CAST(NULL AS STRING), 'entity', 'kb_resolvable', false, false, false, 10
        UNION ALL SELECT 'made_by', CAST(NULL AS STRING), 'entity', 'kb_resolvable', false, false, false, 11
        UNION ALL SELECT 'residence_started', 'P17', 'time', 'kb_interval', true, false, false, 12
        UNION ALL SELECT 'residence_ended', 'P17', 'time', 'kb_interval', true, false, false, 17
        UNION ALL SELECT 'greater_than', CAST(NULL AS STRING), 'quantity', 'python', false, false, false, 13
        UNION ALL SELECT 'signup', CAST(NULL AS STRING), 'entity', 'user_authoritative', true, false, false, 14
        UNION ALL SELECT 'purchase', CAST(NULL AS STRING), 'entity', 'kb_resolvable', true, false, false, 15
        UNION ALL SELECT 'ships_from', 'P999', 'entity', 'kb_resolvable', true, false, false, 16""",
    "bindings": """
        SELECT 'located_in' AS predicate, 0 AS place, 'P17' AS property, false AS inverted, true AS single_valued, false AS gated, 'place' AS object_class
        UNION ALL SELECT 'located_in', 1, 'P131', false, true, true, 'country'
        UNION ALL SELECT 'based_in', 0, 'P17', false, false, false, CAST(NULL AS STRING)
        UNION ALL SELECT 'contains', 0, 'P17', true, false, false, CAST(NULL AS STRING)
        UNION ALL SELECT 'ordered_on', 0, 'P585', false, true, false, CAST(NULL AS STRING)""",
    "distributions": """
        SELECT 1 AS id, 'ships_from' AS predicate, 1 AS polarity, 'part_of' AS relation, 'up' AS verdict, false AS retracted
        UNION ALL SELECT 2, 'ships_from', 1, 'is_a', 'neither', false
        UNION ALL SELECT 3, 'ships_from', 0, 'part_of', 'down', false
        UNION ALL SELECT 4, 'made_by', 1, 'is_a', 'both', false
        UNION ALL SELECT 5, 'made_by', 1, 'part_of', 'neither', false
        UNION ALL SELECT 6, 'located_in', 1, 'part_of', 'up', false
        UNION ALL SELECT 7, 'located_in', 1, 'part_of', 'both', true
        UNION ALL SELECT 8, 'located_in', 0, 'part_of', 'down', false
        UNION ALL SELECT 9, 'based_in', 1, 'part_of', 'up', false
        UNION ALL SELECT 10, 'based_in', 1, 'part_of', 'both', false
        UNION ALL SELECT 100 + p_partkey, 'pred_' || CAST(p_partkey % 97 AS STRING), CAST(p_partkey % 2 AS INT), CASE WHEN p_size % 2 = 0 THEN 'is_a' ELSE 'part_of' END,
          CASE p_size % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'both' ELSE 'neither' END, p_partkey % 13 = 0 FROM {part}""",
    "nogoods": """
        SELECT r_regionkey * 100 + n_nationkey AS id, 'transitive_path' AS kind, 'part_of' AS relation, 'N' || CAST(n_nationkey AS STRING) AS source, 'R' || CAST(r_regionkey AS STRING) AS target,
          CASE WHEN n_nationkey % 3 = 0 THEN 'protected' ELSE 'no_path' END AS reason, CAST(r_regionkey * 7 + n_nationkey AS STRING) AS last_used, n_nationkey % 8 = 7 AS retracted
        FROM {nation} CROSS JOIN {region} WHERE n_regionkey <> r_regionkey
        UNION ALL SELECT 10000 + p_partkey, 'transitive_path', 'is_a', 'PT' || CAST(p_partkey AS STRING), 'K' || CAST(p_size % 5 AS STRING), CASE WHEN p_partkey % 17 = 0 THEN 'protected' ELSE 'no_path' END, CAST(p_size AS STRING), p_partkey % 31 = 0 FROM {part}
        UNION ALL SELECT 1000 + n_nationkey, 'transitive_path', 'part_of', 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING), 'blocked', '9', false FROM {nation} WHERE n_nationkey % 9 = 4""",
    "taxonomy": """
        SELECT n_nationkey * 10 AS id, n_name AS a, r_name AS b, 'part_of' AS relation, 'a_subsumed_by_b' AS verdict, n_nationkey % 7 = 6 AS retracted FROM {nation} JOIN {region} ON r_regionkey = n_regionkey
        UNION ALL SELECT 5000 + r_regionkey, r_name, 'World', 'part_of', 'a_subsumed_by_b', false FROM {region}
        UNION ALL SELECT 6000, 'World', 'Universe', 'part_of', 'a_subsumed_by_b', false
        UNION ALL SELECT n_nationkey * 10 + 1, r_name, n_name, 'part_of', CASE n_nationkey % 4 WHEN 0 THEN 'unrelated' ELSE 'b_subsumed_by_a' END, false FROM {nation} JOIN {region} ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0
        UNION ALL SELECT DISTINCT 100000 + CAST(substring(p_brand, 7, 9) AS INT), p_brand, 'Maker#' || CAST(CAST(substring(p_brand, 7, 9) AS INT) % 5 AS STRING), 'is_a', 'a_subsumed_by_b', false FROM {part}
        UNION ALL SELECT DISTINCT 200000 + CAST(substring(p_brand, 7, 9) AS INT), p_brand, 'Maker#' || CAST(CAST(substring(p_brand, 7, 9) AS INT) % 5 AS STRING), 'is_a',
          CASE CAST(substring(p_brand, 7, 9) AS INT) % 6 WHEN 0 THEN 'unrelated' ELSE 'a_subsumed_by_b' END, false FROM {part} WHERE CAST(substring(p_brand, 7, 9) AS INT) % 3 = 0""",
    "claims": """
        SELECT c_custkey * 4 AS claim_id, c_custkey AS statement_id, c_name AS subject, CASE WHEN c_custkey % 2 = 0 THEN 'located_in' ELSE 'based_in' END AS predicate,
          CASE WHEN c_custkey % 24 = 10 THEN p_name WHEN c_custkey % 12 = 1 THEN t.n_name WHEN c_custkey % 16 = 2 THEN 'Union ' || CAST(c_nationkey % 4 AS STRING) WHEN c_custkey % 4 = 0 THEN t.n_name WHEN c_custkey % 4 = 1 THEN u.n_name WHEN c_custkey % 4 = 2 THEN r_name ELSE CASE WHEN c_custkey % 3 = 0 THEN 'nowhere at all' ELSE 'a place near ' || t.n_name END END AS object, 1 - CAST(c_custkey % 5 = 0 AS INT) AS polarity,
          'user_' || CAST(c_custkey % 150 AS STRING) AS party, CASE WHEN c_custkey % 6 < 2 THEN CAST(1995 + c_custkey % 15 AS STRING) END AS valid_from,
          CASE WHEN c_custkey % 10 = 4 THEN 'before_present' END AS valid_until
        FROM {customer} JOIN {nation} t ON t.n_nationkey = c_nationkey JOIN {nation} u ON u.n_nationkey = (c_nationkey + 1 + c_custkey % 3) % 25 JOIN {region} ON r_regionkey = t.n_regionkey
          LEFT JOIN {part} ON p_partkey = 1 + c_custkey % 20
        UNION ALL SELECT c_custkey * 4 + 3, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN u.n_name ELSE t.n_name END, 'contains', c_name, 1 - CAST(c_custkey % 6 = 5 AS INT), 'user_' || CAST(c_custkey % 150 AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)
        FROM {customer} JOIN {nation} t ON t.n_nationkey = c_nationkey JOIN {nation} u ON u.n_nationkey = (c_nationkey + 2) % 25
        UNION ALL SELECT o_orderkey * 4 + 1, o_custkey, 'O' || CAST(o_orderkey AS STRING), 'ordered_on',
          CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
            WHEN 2 THEN CAST(1 + CAST(substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) AS INT) AS STRING) WHEN 3 THEN 'circa 1996'
            ELSE substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) END,
          1 - CAST(o_orderkey % 7 = 0 AS INT), 'user_' || CAST(o_custkey % 150 AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)
        FROM {orders}
        UNION ALL SELECT o_orderkey * 4 + 2, o_custkey, 'O' || CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN 'priced_above' ELSE 'priced_below' END,
          CASE o_orderkey % 3 WHEN 0 THEN '200,000' WHEN 1 THEN '0.3 million' ELSE 'much' END, 1 - CAST(o_orderkey % 4 = 0 AS INT), 'user_' || CAST(o_custkey % 150 AS STRING),
          CAST(NULL AS STRING), CAST(NULL AS STRING)
        FROM {orders}""",
    "tier_u": """
        SELECT event_id AS id, 'user_' || CAST(user_id AS STRING) AS party, 'I' || CAST(event_id % 4 AS STRING) AS subject, event_type AS predicate,
          'item ' || CAST(CAST(floor(value) AS BIGINT) % 6 AS STRING) AS object, CAST(event_id % 5 <> 0 AS INT) AS polarity,
          CASE WHEN event_id % 9 = 2 THEN '2023-11-20' END AS valid_from,
          CASE event_id % 8 WHEN 0 THEN '2023-12-31' WHEN 1 THEN 'before_present' WHEN 2 THEN '2030-01-01' END AS valid_until,
          CASE event_id % 7 WHEN 0 THEN 'externally_verified' WHEN 1 THEN 'contradicted_by_externally_verified' ELSE 'asserted_unverified' END AS status,
          CAST(event_id AS STRING) AS asserted_at, event_id % 17 = 3 AS retracted
        FROM {events}""",
    "party_claims": """
        SELECT event_id AS claim_id, 'user_' || CAST(user_id AS STRING) AS party, 'I' || CAST((event_id + 1) % 4 AS STRING) AS subject, event_type AS predicate,
          'item ' || CAST(CAST(floor(value) AS BIGINT) % 6 AS STRING) AS object, CAST(event_id % 3 <> 0 AS INT) AS polarity
        FROM {events}""",
    "assertions": """
        SELECT id, party, subject, predicate, object, polarity, valid_from, valid_until, status, asserted_at, retracted FROM tier_u
        UNION ALL SELECT s_suppkey + 10000000000, 'user_' || CAST(s_suppkey % 150 AS STRING), s_name, 'ships_from', n_name, 1 - CAST(s_suppkey % 9 = 0 AS INT), NULL, NULL,
          CASE WHEN s_suppkey % 5 = 0 THEN 'externally_verified' ELSE 'asserted_unverified' END, '0', false FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey WHERE s_suppkey % 8 <> 5
        UNION ALL SELECT p_partkey + 20000000000, 'user_' || CAST(p_partkey % 150 AS STRING), 'Part#' || CAST(p_partkey AS STRING), 'made_by', p_brand, 1, NULL, NULL, 'asserted_unverified', '0', p_partkey % 19 = 0 FROM {part}
        UNION ALL SELECT s_suppkey + 30000000000, 'user_' || CAST(s_suppkey % 150 AS STRING), 'a supplier in ' || n_name, 'purchase', 'item 1', 1, NULL, NULL, 'asserted_unverified', '0', false FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
        UNION ALL SELECT s_suppkey + 40000000000, 'user_' || CAST(s_suppkey % 150 AS STRING), 'user', 'identity', s_name, 1, NULL, NULL, 'asserted_unverified', '0', false FROM {supplier} WHERE s_suppkey % 10 = 3
        UNION ALL SELECT c_custkey + 50000000000, 'user_' || CAST(c_custkey % 150 AS STRING), c_name, 'residence_started', CAST(1994 + c_custkey % 2 AS STRING), 1, NULL, NULL, 'asserted_unverified', '0', false FROM {customer} WHERE c_custkey % 6 = 1
        UNION ALL SELECT c_custkey + 60000000000, 'user_' || CAST(c_custkey % 150 AS STRING), c_name, 'based_in', n_name, 1, NULL, NULL, 'asserted_unverified', '0', false FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey WHERE c_custkey % 17 = 0""",
    "all_claims": """
        SELECT claim_id, statement_id, subject, predicate, object, polarity, party, valid_from, valid_until, CAST(NULL AS STRING) AS abstention_reason FROM claims
        UNION ALL SELECT claim_id + 10000000000, claim_id, subject, predicate, object, polarity, party, NULL, NULL, NULL FROM party_claims
        UNION ALL SELECT s_suppkey * 10 + 20000000000, s_suppkey, s_name, 'ships_from', CASE s_suppkey % 4 WHEN 0 THEN t.n_name WHEN 1 THEN r_name WHEN 2 THEN u.n_name ELSE CASE s_suppkey % 16 WHEN 3 THEN 'World' WHEN 7 THEN 'Universe' ELSE 'a country that trades' END END,
          1 - CAST(s_suppkey % 7 = 0 AS INT), 'user_' || CAST(s_suppkey % 150 AS STRING), NULL, NULL, NULL
        FROM {supplier} JOIN {nation} t ON t.n_nationkey = s_nationkey JOIN {nation} u ON u.n_nationkey = (s_nationkey + 3) % 25 JOIN {region} ON r_regionkey = t.n_regionkey
        UNION ALL SELECT s_suppkey * 10 + 20000000001, s_suppkey, s_name, 'located_in', CASE WHEN s_suppkey % 2 = 0 THEN t.n_name ELSE u.n_name END, 1, 'user_' || CAST(s_suppkey % 150 AS STRING), NULL, NULL,
          CASE WHEN s_suppkey % 13 = 0 THEN 'self_referential' END FROM {supplier} JOIN {nation} t ON t.n_nationkey = s_nationkey JOIN {nation} u ON u.n_nationkey = (s_nationkey + 3) % 25
        UNION ALL SELECT s_suppkey * 10 + 20000000002, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'user_' || CAST(s_suppkey % 150 AS STRING) ELSE s_name END, 'prefers', 'green ink', 1, 'user_' || CAST(s_suppkey % 150 AS STRING), NULL, NULL, NULL FROM {supplier}
        UNION ALL SELECT s_suppkey * 10 + 20000000003, s_suppkey, 'a supplier in ' || n_name, 'purchase', 'item 2', 1, 'user_' || CAST(s_suppkey % 150 AS STRING), NULL, NULL, NULL FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
        UNION ALL SELECT n_nationkey * 10 + 20000000004 + 9000000000, n_nationkey, n_name, 'located_in', CASE WHEN n_nationkey % 2 = 0 THEN 'a place that trades' ELSE 'some continent' END, 1, 'user_1', NULL, NULL, NULL FROM {nation}
        UNION ALL SELECT p_partkey * 10 + 30000000000, p_partkey, 'Part#' || CAST(p_partkey AS STRING), 'made_by', CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE 'Maker#' || CAST((CAST(substring(p_brand, 7, 9) AS INT) + p_partkey % 2) % 5 AS STRING) END,
          1, 'user_' || CAST(p_partkey % 150 AS STRING), NULL, NULL, NULL FROM {part}
        UNION ALL SELECT o_orderkey + 40000000000, o_custkey, CAST(o_orderkey % 5000 AS STRING), 'greater_than', CAST(o_custkey AS STRING), 1 - CAST(o_orderkey % 8 = 0 AS INT), 'user_1', NULL, NULL, NULL FROM {orders}
        UNION ALL SELECT c_custkey * 10 + 50000000000, c_custkey, c_name, CASE WHEN c_custkey % 4 = 3 THEN 'residence_ended' ELSE 'residence_started' END, CASE WHEN c_custkey % 48 = 19 THEN CAST(2012 + c_custkey % 9 AS STRING) WHEN c_custkey % 3 = 0 THEN CAST(1990 + c_custkey % 20 AS STRING) ELSE '1994' END,
          1 - CAST(c_custkey % 5 = 2 AS INT), 'user_' || CAST(c_custkey % 150 AS STRING), NULL, NULL, NULL FROM {customer}""",
    "truths": """
        SELECT c_custkey * 4 AS claim_id, CASE WHEN (c_custkey % 4 IN (0, 2) OR c_custkey % 12 = 1) = (c_custkey % 5 <> 0) THEN 'verified' ELSE 'contradicted' END AS truth FROM {customer} WHERE c_custkey % 4 < 3 AND c_custkey % 16 <> 2 AND c_custkey % 24 NOT IN (0, 10) AND c_custkey % 11 <> 0
        UNION ALL SELECT c_custkey * 4, CASE WHEN (c_nationkey % 3 <> 0) = (c_custkey % 5 <> 0) THEN 'verified' ELSE 'contradicted' END FROM {customer} WHERE c_custkey % 16 = 2 AND c_nationkey % 4 <> 3 AND c_custkey % 24 NOT IN (0, 10) AND c_custkey % 11 <> 0
        UNION ALL SELECT c_custkey * 4 + 3, CASE WHEN (c_custkey % 3 <> 0) = (c_custkey % 6 <> 5) THEN 'verified' ELSE 'contradicted' END FROM {customer} WHERE c_custkey % 24 NOT IN (0, 19) AND c_custkey % 11 <> 0
        UNION ALL SELECT s_suppkey * 10 + 20000000001, CASE WHEN s_suppkey % 2 = 0 THEN 'verified' ELSE 'contradicted' END FROM {supplier}
        UNION ALL SELECT o_orderkey + 40000000000, CASE WHEN (o_orderkey % 5000 > o_custkey) = (o_orderkey % 8 <> 0) THEN 'verified' ELSE 'contradicted' END FROM {orders}
        UNION ALL SELECT o_orderkey * 4 + 1, CASE WHEN (o_orderkey % 5 <> 2) = (o_orderkey % 7 <> 0) THEN 'verified' ELSE 'contradicted' END FROM {orders} WHERE o_orderkey % 5 <> 3
        UNION ALL SELECT o_orderkey * 4 + 2, CASE WHEN CASE o_orderkey % 2 WHEN 0 THEN floor(o_totalprice) > CASE o_orderkey % 3 WHEN 0 THEN 200000 ELSE 300000 END ELSE floor(o_totalprice) < CASE o_orderkey % 3 WHEN 0 THEN 200000 ELSE 300000 END END = (o_orderkey % 4 <> 0) THEN 'verified' ELSE 'contradicted' END
        FROM {orders} WHERE o_orderkey % 3 < 2 AND o_orderkey % 6 <> 1
        UNION ALL SELECT s_suppkey * 10 + 20000000000, CASE WHEN (s_suppkey % 4 <> 2) = (s_suppkey % 7 <> 0) THEN 'verified' ELSE 'contradicted' END FROM {supplier} WHERE s_suppkey % 9 <> 0
        UNION ALL SELECT p_partkey * 10 + 30000000000, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN 'verified' ELSE 'contradicted' END FROM {part}
        UNION ALL SELECT c_custkey * 10 + 50000000000, CASE WHEN (c_custkey % 48 = 19 OR c_custkey % 3 = 0) = (c_custkey % 5 <> 2) THEN 'verified' ELSE 'contradicted' END FROM {customer} WHERE (c_custkey % 24 = 19 OR (c_custkey % 3 = 0 AND c_custkey % 4 <> 3)) AND c_custkey % 11 <> 0 AND c_custkey % 7 <> 0
        UNION ALL SELECT c.claim_id + 10000000000, CASE WHEN c.polarity = k.polarity THEN 'verified' ELSE 'contradicted' END FROM party_claims c JOIN (SELECT party, subject, predicate, min(object) AS object, min(polarity) AS polarity FROM tier_u
            WHERE NOT retracted AND (valid_until IS NULL OR (valid_until <> 'before_present' AND valid_until > '2024-01-15')) GROUP BY party, subject, predicate HAVING count(DISTINCT object) = 1 AND count(DISTINCT polarity) = 1) k
          ON k.party = c.party AND k.subject = c.subject AND k.predicate = c.predicate AND k.object = c.object""",
    "retractions": """
        SELECT 'assertions' AS source_table, event_id AS row_id FROM {events} WHERE event_type = 'signup' AND value > 100
        UNION ALL SELECT 'assertions', s_suppkey + 10000000000 FROM {supplier} WHERE s_acctbal < 1000
        UNION ALL SELECT 'assertions', s_suppkey + 40000000000 FROM {supplier} WHERE s_acctbal < 3000
        UNION ALL SELECT 'taxonomy', n_nationkey * 10 FROM {nation} WHERE n_name < 'B'""",
    "verdicts": """
        SELECT doc_id AS claim_id, CAST(floor(doc_id / 8) AS BIGINT) AS verification_id, CAST(floor(doc_id / 3) AS BIGINT) AS statement_id,
          CASE doc_id % 11 WHEN 0 THEN 'verified' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'verified_given_assertion' WHEN 3 THEN 'contradicted_given_assertion'
            WHEN 4 THEN 'no_grounding_found_given_assertion' WHEN 5 THEN 'verified' WHEN 6 THEN 'verified' ELSE 'no_grounding_found' END AS verdict,
          CASE doc_id % 4 WHEN 0 THEN 'tier_u' WHEN 1 THEN 'kb' WHEN 2 THEN 'python' END AS source,
          CASE WHEN doc_id % 11 >= 7 THEN CASE doc_id % 5 WHEN 0 THEN 'walk_budget_exceeded' WHEN 1 THEN 'not_checkworthy' WHEN 2 THEN 'depth_exhausted' ELSE 'no_kb_path' END END AS abstention_reason,
          doc_id % 5 AS depth, doc_id % 3 AS llm_calls, n_chars AS size, lang, doc_id % 9 = 0 AS temporal_scope_unconfirmed,
          CASE WHEN doc_id % 11 IN (1, 3) AND doc_id % 2 = 0 THEN 'value ' || CAST(doc_id % 10 AS STRING) END AS contradicting_value
        FROM {documents}""",
    "cases": """
        SELECT d.doc_id AS case_id, d.lang AS failure_mode, CASE d.doc_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'contradicted' ELSE 'abstain' END AS ground_truth,
          CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN CASE d.doc_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'contradicted' ELSE 'abstain' END
            WHEN l.toxic = 1 THEN 'verified' ELSE CASE d.doc_id % 4 WHEN 0 THEN 'contradicted' WHEN 1 THEN 'error' ELSE 'no_grounding_found' END END AS verdict,
          CASE d.doc_id % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'contradicted' ELSE 'abstain' END AS baseline, CAST(d.n_chars AS DOUBLE) / 10.0 AS latency, d.doc_id % 4 AS run_id
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "premises": """
        SELECT l_orderkey * 10 + l_linenumber AS premise_id, l_orderkey AS claim_id, l_linenumber AS literal_index, l_suppkey % 3 AS alternative,
          CASE l_partkey % 3 WHEN 0 THEN 'tier_u' WHEN 1 THEN 'kb' ELSE 'substrate' END AS source,
          CASE l_partkey % 3 WHEN 0 THEN 'tier_u' WHEN 1 THEN NULL WHEN 2 THEN 'subsumption' END AS source_table, l_partkey AS source_row_id, l_partkey % 3 = 0 AND l_returnflag = 'A' AS is_assertion
        FROM {lineitem}""",
    "mappings": """
        SELECT p_partkey AS id, 'pred_' || CAST(p_partkey % 97 AS STRING) AS predicate, 'P' || CAST(p_partkey % 41 AS STRING) AS property,
          CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'statement_value' ELSE 'subject' END AS subject_slot,
          CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'subject' ELSE 'statement_value' END AS object_slot,
          CASE p_partkey % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'place' END AS subject_type, CASE p_partkey % 4 WHEN 0 THEN 'place' WHEN 1 THEN 'human' END AS object_type,
          p_partkey % 6 <> 0 AS single_valued, p_partkey % 29 = 0 AS pinned, p_partkey % 13 = 0 AS retracted, p_retailprice AS consulted
        FROM {part}""",
    "ontology": """
        SELECT 'P' || CAST(p_partkey % 41 AS STRING) AS property, CASE p_size % 4 WHEN 0 THEN 'subject_type' WHEN 1 THEN 'value_type' ELSE 'inverse' END AS kind, CASE p_size % 4 WHEN 2 THEN 'P' || CAST(p_size AS STRING) ELSE p_brand END AS value,
          CASE WHEN p_partkey % 1000 = 7 THEN '2023-12-31' ELSE '2024-02-01' END AS expires FROM {part}
        UNION ALL SELECT 'P9' || CAST(p_size AS STRING), 'empty', '', '2024-02-01' FROM {part} WHERE p_size > 40""",
    "premise_slots": """
        SELECT 'priced_above' AS predicate, 'subject' AS slot, 'P2284' AS property UNION ALL SELECT 'ordered_on', 'subject', 'P585' UNION ALL SELECT 'located_in', 'subject', 'P17' UNION ALL SELECT 'located_in', 'object', 'P30'""",
    "baselines": """
        SELECT doc_id AS case_id, CASE WHEN toxic = 1 THEN 'verified' WHEN quality = 1 THEN 'contradicted' ELSE 'abstain' END AS verdict FROM {labels}""",
    "aliases": """
        SELECT 'N' || CAST(n_nationkey AS STRING) AS kb_id, lower(n_name) || ' land' AS alias FROM {nation} UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'customer ' || CAST(c_custkey % 40 AS STRING) FROM {customer} WHERE c_custkey % 3 = 0""",
    "resolutions": """
        SELECT c_custkey AS id, c_name AS reference, CASE WHEN c_custkey % 2 = 0 THEN 'C' || CAST(c_custkey AS STRING) ELSE '' END AS kb_id, c_custkey % 35 = 0 AS retracted FROM {customer} WHERE c_custkey % 5 = 0""",
    "redirects": """
        SELECT 'customer ' || CAST(c_custkey AS STRING) AS title, c_name AS target FROM {customer} UNION ALL SELECT lower(n_name) || ' land', n_name FROM {nation}""",
    "surfaces": """
        SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN c_name WHEN 1 THEN 'customer ' || CAST(c_custkey AS STRING) WHEN 2 THEN lower(n_name) || ' land' WHEN 3 THEN p_name WHEN 4 THEN n_name ELSE 'nobody of that name' END AS reference,
          CASE o_orderkey % 4 WHEN 0 THEN 'country' WHEN 1 THEN 'B11' ELSE NULL END AS expected_type
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey LEFT JOIN {part} ON p_partkey = 1 + o_orderkey % 100""",
    "dated_texts": """
        SELECT id, CASE id % 13 WHEN 0 THEN long || ' ' || d || ', ' || y WHEN 1 THEN d || ' ' || long || ' ' || y WHEN 2 THEN substring(long, 1, 3) || ' ' || d || ' ' || y WHEN 3 THEN ' ' || long || ' ' || y WHEN 4 THEN d || 'th of ' || upper(long) || ', ' || y
            WHEN 5 THEN '-' || iso WHEN 6 THEN iso || 'T00:00:00Z' WHEN 7 THEN '+' || substring(iso, 1, 7) WHEN 8 THEN y || ' BC' WHEN 9 THEN 'in ' || y || ' or so' WHEN 10 THEN y || '-13-40' WHEN 11 THEN y || '0000' ELSE substring(long, 1, 3) || '. ' || y || ' b.c.e.' END AS text
        FROM (SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso, substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) AS y, CAST(CAST(substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) AS INT) AS STRING) AS d,
          trim(substring('January   February  March     April     May       June      July      August    September October   November  December  ', CAST(substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) AS INT) * 10 - 9, 10)) AS long FROM {orders})""",
    "subsumptions": """
        SELECT p_partkey AS id, p_name AS a, 'class ' || CAST(p_size % 3 AS STRING) AS b, CASE WHEN p_size % 2 = 0 THEN 'is_a' ELSE 'part_of' END AS relation,
          CASE p_partkey % 5 WHEN 0 THEN 'b_subsumed_by_a' WHEN 1 THEN 'unrelated' WHEN 2 THEN 'equivalent' ELSE 'a_subsumed_by_b' END AS verdict, p_partkey % 11 = 0 AS retracted
        FROM {part}""",
    "seed_rows": """
        SELECT s_suppkey AS id, 'pred_' || CAST(s_suppkey % 97 AS STRING) AS predicate, 'P' || CAST(s_suppkey % 41 AS STRING) AS property FROM {supplier}""",
    "mapping_retractions": """
        SELECT DISTINCT l_partkey AS id FROM {lineitem} WHERE l_returnflag = 'R' AND l_linenumber = 1""",
    "requests": """
        SELECT id AS request_id, CASE WHEN id % 10 = 9 THEN 'user_' || CAST(id % 150 AS STRING) WHEN id % 17 = 3 THEN 'event_' || CAST(id AS STRING) WHEN id % 31 = 5 THEN 'the ' || reference ELSE reference END AS reference,
          expected_type, CASE id % 3 WHEN 0 THEN 'located_in' WHEN 1 THEN 'made_by' END AS predicate, CASE WHEN id % 2 = 0 THEN 'subject' ELSE 'object' END AS slot, 'user_' || CAST(id % 150 AS STRING) AS party
        FROM surfaces""",
    "context_cache": """
        SELECT DISTINCT reference AS form, predicate, slot, party, CASE WHEN request_id % 8 = 0 THEN 'C' || CAST(request_id % 90 AS STRING) ELSE '' END AS kb_id,
          CASE WHEN request_id % 3 = 0 THEN '2024-01-02' ELSE '2024-01-01' END AS created_at, request_id % 20 = 0 AS retracted
        FROM requests WHERE request_id % 4 = 0""",
    "entity_kinds": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS entity, 'human' AS kind FROM {customer} UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'place' FROM {customer} WHERE c_custkey % 10 = 0
        UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'place' FROM {nation} UNION ALL SELECT 'R' || CAST(r_regionkey AS STRING), 'place' FROM {region}""",
    "role_constraints": """
        SELECT DISTINCT 'P35' AS property, 'subject' AS role, 'human' AS kind FROM {region} UNION ALL SELECT DISTINCT 'P35', 'value', 'place' FROM {region} UNION ALL SELECT DISTINCT 'P30', 'subject', 'human' FROM {region}""",
    "direction_statements": """
        SELECT 'P17' AS property, 'C' || CAST(c_custkey AS STRING) AS entity, 'N' || CAST(c_nationkey AS STRING) AS value, 'normal' AS rank FROM {customer}
        UNION ALL SELECT 'P36', 'N' || CAST(c_nationkey AS STRING), 'C' || CAST(min(c_custkey) AS STRING), 'normal' FROM {customer} GROUP BY c_nationkey
        UNION ALL SELECT 'P30', 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING), 'preferred' FROM {nation}
        UNION ALL SELECT 'P26', 'C' || CAST(a.c_custkey AS STRING), 'C' || CAST(b.c_custkey AS STRING), 'normal' FROM {customer} a JOIN {customer} b ON b.c_custkey = CASE WHEN a.c_custkey % 2 = 0 THEN a.c_custkey + 1 ELSE a.c_custkey - 1 END
        UNION ALL SELECT 'P38', 'C' || CAST(a.c_custkey AS STRING), 'N' || CAST(a.c_nationkey AS STRING), 'normal' FROM {customer} a
        UNION ALL SELECT 'P38', 'N' || CAST(a.c_nationkey AS STRING), 'C' || CAST(a.c_custkey AS STRING), 'normal' FROM {customer} a WHERE a.c_custkey % 7 <> 1
        UNION ALL SELECT 'P33', 'C' || CAST(c_custkey AS STRING), 'N' || CAST(c_nationkey AS STRING), 'deprecated' FROM {customer}
        UNION ALL SELECT 'P35', 'PT' || CAST(p_partkey AS STRING), 'S' || CAST(p_size AS STRING), 'normal' FROM {part}""",
}


def with_views(*names: str) -> str:
    """WITH and the named views, those that they use first."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in VIEWS:
            if other != name and re.search(rf"(FROM|JOIN) {other}\b", VIEWS[name]):
                add(other)
        order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = f"{with_views(name)} SELECT * FROM {name}"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: the named views and then body, whose leading WITH (if any) goes on from them."""
    text = with_views(*names).format(**{t: t for t in TABLES})
    body = body.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        return (text.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + rest.removeprefix("RECURSIVE ")) if rest.startswith("RECURSIVE ") else f"{text}, {rest}"
    return f"{text} {body}"
