"""The four incident tables, derived from the order/customer/line-item tables.

Each column is one SQL expression.  Spark evaluates it lazily, so a query that
needs three columns reads only the parquet columns behind those three.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

_STATION = (
    "CASE CAST(o_custkey % 16 AS INT)"
    " WHEN 0 THEN 'Gunadala' WHEN 1 THEN 'A. Konduru' WHEN 2 THEN 'Nandigama Rural'"
    " WHEN 3 THEN 'Cyber Crime' WHEN 4 THEN 'Vijayawada Traffic II' WHEN 5 THEN 'Patamata'"
    " WHEN 6 THEN 'Elsewhere' WHEN 7 THEN '' WHEN 8 THEN 'Krishna Lanka | Year 2024'"
    " WHEN 9 THEN 'Machavaram, Vijayawada' WHEN 10 THEN 'I Town  Crime' WHEN 11 THEN 'AS Nagar.'"
    " WHEN 12 THEN 'Tiruvuru District NTR' WHEN 13 THEN 'Traffic V' WHEN 14 THEN 'Mahila UPS'"
    " ELSE 'Vatsvai - ' END"
)
_ADDRESS = (
    "CASE CAST(o_custkey % 11 AS INT)"
    " WHEN 0 THEN 'Near Benz Circle, MG Road' WHEN 1 THEN 'Opp. RTC Bus Stand, Auto Nagar'"
    " WHEN 2 THEN 'NH65, Nandigama Mandal' WHEN 3 THEN 'Road' WHEN 4 THEN NULL"
    " WHEN 5 THEN 'behind Police Station, Governorpet' WHEN 6 THEN 'Main street 4'"
    " WHEN 7 THEN 'Ring Road, Kanuru, Penamaluru' WHEN 8 THEN 'p.s. limits'"
    " WHEN 9 THEN 'Railway, Tiruvuru' ELSE '' END"
)
_DAY = (
    "concat(lpad(CAST(day(o_orderdate) AS VARCHAR(2)),2,'0'),'-',"
    "lpad(CAST(month(o_orderdate) AS VARCHAR(2)),2,'0'),'-',CAST(year(o_orderdate) AS VARCHAR(4)))"
)
_RAW_TEXT = (
    "concat("
    "CASE WHEN o_orderkey % 3 = 0 THEN concat('Location: ', coalesce(" + _ADDRESS + ", 'Village 9'), chr(10))"
    " ELSE concat('FIRST INFORMATION REPORT', chr(10)) END,"
    "CASE WHEN o_custkey % 5 = 0 THEN 'Police Station: ' ELSE 'P.S.: ' END, " + _STATION + ", chr(10),"
    "CASE WHEN o_orderkey % 4 = 0 THEN 'Crime No. ' ELSE 'FIR No: ' END,"
    "CAST(o_orderkey AS VARCHAR(20)), '/', CAST(year(o_orderdate) AS VARCHAR(4)), chr(10),"
    "'Date: ', " + _DAY + ", CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat(' ',"
    " lpad(CAST((o_orderkey*7) % 24 AS VARCHAR(2)),2,'0'), ':15') END, chr(10),"
    "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Cause: over speeding by the driver.'"
    " WHEN 1 THEN 'Reason - complainant statement' WHEN 2 THEN 'The car was in rash driving mode'"
    " WHEN 3 THEN 'cause : brake failure' ELSE 'No remark' END, chr(10),"
    "CASE WHEN o_orderkey % 7 < 3 THEN concat('Age: ', CAST(o_custkey % 90 AS VARCHAR(3)), ' Gender: Male', chr(10))"
    " ELSE '' END,"
    "CASE WHEN o_orderkey % 7 < 2 THEN concat('Age - ', CAST(o_custkey % 70 AS VARCHAR(3)), chr(10)) ELSE '' END,"
    "CASE WHEN o_orderkey % 8 < 5 THEN concat('Vehicle No: AP ', lpad(CAST(o_custkey % 40 AS VARCHAR(2)),2,'0'),"
    " ' ab ', CAST(o_orderkey % 9000 AS VARCHAR(4)), chr(10)) ELSE '' END,"
    "CASE WHEN o_orderkey % 8 < 2 THEN concat('Reg. No. TS09C', CAST(o_custkey % 900 AS VARCHAR(3)), chr(10)) ELSE '' END,"
    "CASE o_orderstatus WHEN 'F' THEN 'The victim died on the spot' WHEN 'O' THEN 'He has a fracture'"
    " ELSE 'No injuries' END)"
)
_AI_ANALYSIS = (
    "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN NULL"
    " WHEN 1 THEN concat('{\"summary\":\"s', CAST(o_orderkey AS VARCHAR(20)),"
    " '\",\"risk_score\":', CAST(o_orderkey % 10 AS VARCHAR(2)), ',\"legal_analysis\":\"section 304A\",\"contributing_factors\":[\"speed\",\"rain\"]}')"
    " WHEN 2 THEN concat('{\"summary\":\"t\",\"risk_score\":', CAST(o_orderkey % 7 AS VARCHAR(2)),"
    " ',\"legal_analysis\":{\"applicable_sections\":\"279\",\"penalty_range\":\"2 years\"},\"contributing_factors\":[\"fog\"]}')"
    " ELSE '{\"summary\":\"broken' END"
)

_SEVERITY = (
    "CASE o_orderstatus WHEN 'F' THEN 'Fatal' WHEN 'O' THEN 'Grievous'"
    " ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'Unknown' ELSE 'Non-Fatal' END END"
)

ACCIDENTS = {
    "id": "o_orderkey",
    "fir_number": "concat('FIR/', CAST(year(o_orderdate) AS VARCHAR(4)), '/', CAST(o_orderkey AS VARCHAR(20)))",
    "incident_date": "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate"
    " + CAST((o_orderkey*7) % 24 AS INT) * INTERVAL '1' HOUR END",
    "reported_date": "o_orderdate + INTERVAL '1' DAY",
    "cause": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Over Speeding' WHEN '2-HIGH' THEN 'Rash driving'"
    " WHEN '3-MEDIUM' THEN CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'Drunk driving' WHEN 1 THEN 'Signal jumping'"
    " WHEN 2 THEN 'Wrong side entry' WHEN 3 THEN 'Negligent act' WHEN 4 THEN 'Hit and run' ELSE 'Brake failure' END"
    " WHEN '4-NOT SPECIFIED' THEN 'Under Investigation' ELSE NULL END",
    "severity": _SEVERITY,
    "pdf_url": "concat('https://files.example/fir-pdfs/', CAST(o_custkey % 100 AS VARCHAR(3)), '/Report-',"
    " CAST(o_orderkey AS VARCHAR(20)), '.pdf')",
    "status": "'Processed'",
    "confidence_score": "CAST(o_orderkey % 101 AS DOUBLE)/100.0",
    "raw_text": _RAW_TEXT,
    "ai_analysis": _AI_ANALYSIS,
    "created_at": "o_orderdate + INTERVAL '1' DAY + CAST(o_orderkey % 7 AS INT) * INTERVAL '1' HOUR",
}
LOCATIONS = {
    "id": "o_orderkey",
    "accident_id": "o_orderkey",
    "address": _ADDRESS,
    "area": "CASE WHEN c_custkey % 40 = 0 THEN NULL WHEN c_custkey % 40 = 1 THEN '  '"
    " WHEN c_custkey % 3 = 0 THEN CASE CAST(c_custkey % 17 AS INT) WHEN 0 THEN 'Gunadala' WHEN 1 THEN 'patamata center'"
    " WHEN 2 THEN 'Vijayawada' WHEN 3 THEN 'Old Vijayawada' WHEN 4 THEN 'Nunna Village' WHEN 5 THEN 'G. Konduru Mandal'"
    " WHEN 6 THEN 'A Konduru Mandal' WHEN 7 THEN 'Nandigama town' WHEN 8 THEN 'Cyber Crime' WHEN 9 THEN 'Traffic point'"
    " WHEN 10 THEN 'Vijayawada Traffic II' WHEN 11 THEN 'Auto Nagar' WHEN 12 THEN 'Gollapudi' WHEN 13 THEN 'Jaggaiahpet'"
    " WHEN 14 THEN 'near I Town' WHEN 15 THEN 'Krishnalanka' ELSE 'Vatsavai-mandal' END"
    " ELSE concat('Area ', CAST(c_custkey % 37 AS VARCHAR(2))) END",
    "city": "n_name",
    "landmark": "CAST(NULL AS VARCHAR(10))",
    "latitude": "CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 16.25 + CAST(c_custkey % 70 AS DOUBLE)/100.0 END",
    "longitude": "CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 80.0 + CAST(c_custkey % 90 AS DOUBLE)/100.0 END",
}
_ROW_ID = "(l_orderkey * 8 + l_linenumber) * 1000003 + (l_partkey * 7919 + l_suppkey + CAST(l_quantity AS INT) * 131) % 1000003"
VICTIMS = {
    "id": _ROW_ID,
    "accident_id": "l_orderkey",
    "victim_name": "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE concat('Victim ', CAST(l_partkey AS VARCHAR(20))) END",
    "age": "CASE WHEN l_quantity > 45 THEN NULL ELSE CAST(l_quantity*2 AS INT) - 2 END",
    "gender": "CASE l_returnflag WHEN 'A' THEN 'Male' WHEN 'R' THEN 'Female' ELSE NULL END",
    "injury_severity": "CASE WHEN l_partkey % 3 = 0 THEN 'Grievous' ELSE 'Simple' END",
    "is_fatality": "o_orderstatus = 'F'",
}
VEHICLES = {
    "id": _ROW_ID,
    "accident_id": "l_orderkey",
    "vehicle_type": "CASE WHEN p_type = 'SMALL' THEN 'Unknown' ELSE p_type END",
    "vehicle_number": "concat('AP', lpad(CAST(l_suppkey % 40 AS VARCHAR(2)),2,'0'), 'AB',"
    " lpad(CAST(l_partkey % 10000 AS VARCHAR(4)),4,'0'))",
    "driver_name": "CASE WHEN l_suppkey % 10 = 0 THEN 'Unknown' ELSE s_name END",
}


# Known layouts of the input tables: with them a read needs no footer-reading job.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


# Line items that one task joins, about.
PART_LINES = 1_000_000


class Star:
    """Lazy handle on the incident tables below one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.parts = spark, sf_dir, 1

    def raw(self, name: str) -> DataFrame:
        return _read(self.spark, self.sf_dir, name)

    def spread(self) -> Star:
        """The same tables, the line items dealt by report to as many tasks as their number asks for.

        The joins by report that follow keep these tasks, each with about PART_LINES line items,
        however many there are.
        """
        star = Star(self.spark, self.sf_dir)
        star.parts = self.raw("lineitem").count() // PART_LINES + 1
        return star

    def _lines(self, condition: str) -> DataFrame:
        lines = self.raw("lineitem").filter(condition)
        return lines if self.parts == 1 else lines.repartition(self.parts, "l_orderkey")

    @cached_property
    def acc(self) -> DataFrame:
        return _project(self.raw("orders"), ACCIDENTS)

    @cached_property
    def loc(self) -> DataFrame:
        joined = self.raw("orders").join(
            self.raw("customer"), F.expr("o_custkey = c_custkey")
        ).join(self.raw("nation"), F.expr("c_nationkey = n_nationkey"))
        return _project(joined, LOCATIONS)

    @cached_property
    def vic(self) -> DataFrame:
        lines = self._lines("l_linenumber <= 3")
        return _project(lines.join(self.raw("orders"), F.expr("l_orderkey = o_orderkey")), VICTIMS)

    @cached_property
    def veh(self) -> DataFrame:
        lines = self._lines("l_linenumber >= 4")
        joined = lines.join(self.raw("part"), F.expr("l_partkey = p_partkey")).join(
            self.raw("supplier"), F.expr("l_suppkey = s_suppkey")
        )
        return _project(joined, VEHICLES)

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")


def _select(columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items())


# the same derivation as common table expressions, for an independent engine
PRELUDE = (
    "WITH RECURSIVE accidents AS (" + _select(ACCIDENTS) + " FROM orders), "
    "locations AS (" + _select(LOCATIONS)
    + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), "
    "victims AS (" + _select(VICTIMS)
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 3), "
    "vehicles AS (" + _select(VEHICLES)
    + " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
    " WHERE l_linenumber >= 4)"
)
