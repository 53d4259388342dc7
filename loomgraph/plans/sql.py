"""SQL of the table graphs, shared by the queries' oracles."""

TRADE = """trade AS (
  SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::DOUBLE AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2
)"""


SUPPLY = """e AS (
  SELECT l_partkey AS src, l_suppkey + 1000000 AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2
), n AS (SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey + 1000000 FROM supplier)"""

BOTH = "u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)"
USERS = """steps AS (
  SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events
), e AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM steps WHERE dst IS NOT NULL GROUP BY 1, 2)"""


def strongest(k: int) -> str:
    return f"""{USERS.replace("e AS", "steps_e AS")}, e AS (
  SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM steps_e WHERE src <> dst) WHERE place <= {k}
), n AS (SELECT DISTINCT user_id AS id FROM events)"""


#: Each user's three heaviest links, and the heaviest alone.
SPARSE = strongest(3)
SPLIT = strongest(1)
#: Two links for each user, directed from the smaller id to the larger one.
ACYCLIC = strongest(2).replace("e AS (\n", "f AS (\n") + ", e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM f GROUP BY 1, 2)"
