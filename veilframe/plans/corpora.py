"""Text corpora derived from the given tables by SQL that reads the same in ANSI engines.

The tables hold few UK identifiers and names, so these views compose texts that contain
them from the rows of ``customer``, ``orders``, ``nation`` and ``conversations``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from veilframe.session import spread

_MONTHS = ("January,February,March,April,May,June,July,August,September,October,"
           "November,December")

PLANTED = """
WITH k AS (
  SELECT c_custkey, c_name, c_custkey % 5 AS variant,
    lpad(cast((c_custkey * 7919 + 123456789) % 1000000000 AS string), 9, '0') AS n9,
    lpad(cast((c_custkey * 104729 + 60161331926819) % 100000000000000 AS string), 14, '0') AS n14
  FROM {customer}),
w AS (
  SELECT *, (11 - (cast(substr(n9,1,1) AS int) * 10 + cast(substr(n9,2,1) AS int) * 9
      + cast(substr(n9,3,1) AS int) * 8 + cast(substr(n9,4,1) AS int) * 7
      + cast(substr(n9,5,1) AS int) * 6 + cast(substr(n9,6,1) AS int) * 5
      + cast(substr(n9,7,1) AS int) * 4 + cast(substr(n9,8,1) AS int) * 3
      + cast(substr(n9,9,1) AS int) * 2) % 11) % 11 AS chk,
    98 - (((89 * 53 + cast(n14 AS bigint) % 97) % 97 * 27 + 161100) % 97) AS ib
  FROM k),
v AS (
  SELECT *, substr(n9,1,3) || ' ' || substr(n9,4,3) || ' ' || substr(n9,7,3)
    || substr('0123456789X', chk + 1, 1) AS nhs FROM w)
SELECT c_custkey AS doc_id, variant,
  'Dear ' || c_name || ',' || chr(10) || CASE variant
    WHEN 0 THEN 'NI number: AB' || substr(n9,1,6)
      || substr('ABCD', cast(c_custkey % 4 AS int) + 1, 1) || ' on file.'
    WHEN 1 THEN 'Your NHS number is ' || replace(nhs, 'X', '0') || '.'
    WHEN 2 THEN 'Postcode SW' || substr(n9,9,1) || 'A ' || substr(n9,8,1) || 'AA, call 07'
      || substr(n9,1,3) || ' ' || substr(n9,4,6) || '.'
    WHEN 3 THEN 'IBAN GB' || lpad(cast(ib AS string), 2, '0') || 'NWBK' || n14
      || ' or GB00NWBK' || n14 || '.'
    ELSE 'Licence number MORGA' || substr(n9,1,6) || 'SM9IJ.' END AS text
FROM v"""

ORDER_NOTES = f"""
SELECT o_orderkey AS doc_id, 'Order ' || cast(o_orderkey AS string) || ' of ' || CASE o_orderkey % 3
    WHEN 0 THEN cast(cast(o_orderdate AS date) AS string)
    WHEN 1 THEN lpad(cast(day(o_orderdate) AS string), 2, '0') || '/'
      || lpad(cast(month(o_orderdate) AS string), 2, '0') || '/'
      || cast(year(o_orderdate) AS string)
    ELSE cast(day(o_orderdate) AS string) || ' '
      || split_part('{_MONTHS}', ',', cast(month(o_orderdate) AS int)) || ' '
      || cast(year(o_orderdate) AS string) END || ' is closed.' AS text
FROM {{orders}}"""

LETTERS = """
SELECT c_custkey AS doc_id,
  split_part('Mr,Ms,Dr', ',', cast(c_custkey % 3 AS int) + 1) || ' '
  || split_part('Amelia,Owen,Priya,Rhys', ',', cast(c_custkey % 4 AS int) + 1) || ' '
  || split_part('Walsh,Patel,Norris,Quinn,Ellis', ',', cast(c_custkey % 5 AS int) + 1)
  || ' is a ' || split_part('Welsh,British,Polish', ',', cast(c_custkey % 3 AS int) + 1)
  || ' buyer at ' || split_part('Harbour,Meadow,Northern', ',', cast(c_custkey % 3 AS int) + 1)
  || ' Foods ' || split_part('Ltd,plc', ',', cast(c_custkey % 2 AS int) + 1)
  || chr(10) || 'Delivery to ' || n_name || ' in ' || r_name || ' for ' || c_name || '.' AS text
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey"""

SIGNED = """
SELECT conv_id, turn, role, text || ' Reach ' || role || cast(conv_id % 7 AS string) || '.'
  || cast(turn AS string) || '@example.com or 10.0.' || cast(conv_id % 250 AS string) || '.'
  || cast(turn % 250 AS string) AS text
FROM {conversations}"""

LISTING = """
SELECT doc_id, lang, 'corpus/' || lang || '/' || source || '/doc' || cast(doc_id AS string)
  || split_part('.txt,.csv,.eml,.pdf,.docx,.xlsx,.html,.TXT,_scrubbed.txt', ',',
                cast(doc_id % 9 AS int) + 1) AS path
FROM {documents}"""

MAILS = f"""
SELECT doc_id, 'From: c' || cast(doc_id AS string) || '@example.com' || chr(10)
  || 'To: desk@example.com' || chr(10) || 'Subject: Account ' || cast(doc_id AS string) || chr(10)
  || 'Content-Type: text/plain; charset="utf-8"' || chr(10) || chr(10) || text || chr(10) AS mail
FROM ({PLANTED}) AS p"""


ADDRESSES = """
SELECT c_custkey AS doc_id, 'at ' || CASE c_custkey % 12
    WHEN 0 THEN '2001:db8::' WHEN 1 THEN '::' WHEN 2 THEN cast(c_custkey AS string) || '::2'
    WHEN 3 THEN '::ffff:10.1.2.' || cast(c_custkey % 250 AS string)
    WHEN 4 THEN '1::2::' || cast(c_custkey % 9 AS string) WHEN 5 THEN '12:30:' || cast(c_custkey % 50 + 10 AS string)
    WHEN 6 THEN '2001:0db8:0:0:0:0:0:' || cast(c_custkey % 9 AS string) WHEN 7 THEN 'fe80::1%eth0'
    WHEN 8 THEN 'aa:bb:cc:dd:ee:ff' WHEN 9 THEN '1:2:3:4:5:6:7:8:9' WHEN 10 THEN 'std::vector or ::1.'
    ELSE '64:ff9b::192.0.2.' || cast(c_custkey % 300 AS string) || '/96' END || ' and [::1], 2001:DB8::'
  || cast(c_custkey % 10 AS string) || ': end' AS text
FROM {customer}"""

# Documents, planted identifiers and letters in one table, so that every rule finds something.
MIXED = f"""
SELECT doc_id, lang, text FROM {{documents}}
UNION ALL SELECT 1000000000 + doc_id, 'planted', text FROM ({PLANTED}) AS p
UNION ALL SELECT 2000000000 + doc_id, 'letter', text FROM ({LETTERS}) AS l"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the views above over the tables it names in braces."""
    names = ("customer", "orders", "nation", "region", "conversations", "documents")
    used = {n: table(spark, sf_dir, n) for n in names if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def portable(sql: str) -> str:
    """The view for an engine that has the tables under their plain names."""
    for n in ("customer", "orders", "nation", "region", "conversations", "documents"):
        sql = sql.replace("{" + n + "}", n)
    return sql
