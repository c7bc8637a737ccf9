"""Log-shaped views over star-schema tables, so every operator can run on the tables at hand.

``VIEWS`` holds the expressions once; both Spark and an independent SQL engine can run them. The line table is
the exception: its SQL numbers lines with a plain window, while ``lines`` uses the blocked running rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators.running import running_rank

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_MESSAGE = """concat(event_type, ' user', cast(user_id as string), ' ', case event_id % 9
 when 0 then 'ERROR connection reset' when 1 then 'warning slow disk' when 2 then 'info accepted'
 when 3 then 'login denied' when 4 then 'request timeout' when 5 then 'critical raid fault'
 when 6 then 'debug trace on' when 7 then 'authentication failure' else 'done' end,
 ' from 198.51.', cast(user_id % 200 as string), '.', cast(event_id % 250 as string),
 ' client aa:bb:cc:dd:', case when user_id % 2 = 0 then 'ee' else 'ef' end, ':', cast(10 + user_id % 80 as string))"""

_LINE_ROWS = f"""select concat('/var/log/', case user_id % 4 when 0 then '' when 1 then 'nginx/'
   else concat('host', cast(user_id % 6 as string), '/') end, 'app', cast(user_id % 3 as string), '.log') as source,
  event_id as id, ts as received_at,
  case when event_id % 13 = 0 then '' when event_id % 10 = 0 then {_MESSAGE}
   else concat(left(cast(ts as string), 19), ' h', cast(user_id % 6 as string), ' unit', cast(event_id % 4 as string),
    '[', cast(event_id % 500 as string), ']: ', {_MESSAGE}) end as line
 from events"""

VIEWS: dict[str, str] = {
    # parsed events
    "b1": f"""select event_id as id, ts as received_at,
 case event_id % 4 when 0 then 'palo_alto' when 1 then 'windows' when 2 then 'generic' else 'mist' end as source_type,
 concat('192.0.2.', cast(user_id % 250 as string)) as remote_ip,
 case when event_id % 3 = 0 then 'tcp' else 'udp' end as transport,
 {_MESSAGE} as message,
 case event_id % 4 when 0 then case when event_id % 8 = 0 then 'TRAFFIC' else 'THREAT' end end as log_type,
 case event_id % 4 when 0 then case event_id % 5 when 0 then 'deny' when 1 then 'drop' when 2 then 'reset-both'
  else 'allow' end end as action,
 case when event_id % 6 < 4 then concat('198.51.', cast(user_id % 200 as string), '.', cast(event_id % 250 as string))
  end as src_ip,
 case when event_id % 6 < 4 then concat('203.0.', cast(user_id % 100 as string), '.', cast(event_id % 50 as string))
  end as dst_ip
from events""",
    # raw syslog messages
    "b2": """select id, received_at, remote_ip, transport,
 case source_type
 when 'palo_alto' then concat('<', cast(8 + id % 8 as string), '>1 2026-04-12T10:15:01Z fw', cast(id % 3 as string),
  ' - - - - 1,2024/01/01 00:00:00,0070,', log_type, ',end,2024/01/02 03:04:0', cast(id % 10 as string), ',1,x,',
  coalesce(src_ip,'198.51.100.1'), ',', coalesce(dst_ip,'203.0.113.9'),
  ',0,0,"rule, a",,,ssl,vsys1,Trust,Untrust,e1,e2,fwd,t,5,', cast(1024 + id % 5000 as string), ',',
  cast(id % 1000 as string), ',tcp,', action, ',0,0,0,0')
 when 'windows' then concat('<', cast(8 + id % 8 as string), '>1 2026-04-12T10:15:01.000Z host',
  cast(id % 5 as string), ' WindowsEvents - - - ', message)
 else concat('<', cast(128 + id % 8 as string), '>Jan ', cast(1 + id % 28 as string), ' 00:00:00 host',
  cast(id % 5 as string), ' app[', cast(id % 99 as string), ']: ', message) end as raw
from b1""",
    # numbered log lines of twelve files
    "b3": f"""select source, row_number() over (partition by source order by id) - 1 as line_index, line,
 received_at, id from ({_LINE_ROWS}) x""",
    # analyses, jobs and schedules
    "b4": """select o_orderkey as id, o_orderdate as created_at,
 case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium'
  when '5-LOW' then 'low' else 'info' end as severity,
 case when o_orderstatus = 'P' then 'model timeout' end as error,
 concat('summary of order ', cast(o_orderkey as string)) as summary,
 case when o_orderkey % 11 = 0 then '(auto-skip)' else 'stub' end as model,
 case o_orderkey % 4 when 0 then '[]' when 1 then '[{"title":"a","detail":"d","related_log_indexes":[0]}]'
  when 2 then '[{"title":"a","detail":"d","related_log_indexes":[0]},{"title":"b","detail":"e","related_log_indexes":[1,2]}]'
  else '[]' end as anomalies_json
from orders""",
    # flow records
    "b5": """select concat('198.', cast(18 + l_suppkey % 2 as string), '.', cast(l_suppkey % 100 as string), '.',
  cast(l_linenumber as string)) as src_ip,
 concat('203.0.', cast(l_partkey % 40 as string), '.', cast(l_partkey % 25 as string)) as dst_ip,
 l_shipdate as ts, cast(l_quantity as bigint) as bytes,
 case when l_suppkey % 7 <> 0 then cast(l_suppkey % 90 as double) end as src_lat,
 case when l_suppkey % 7 <> 0 then cast(l_suppkey % 180 as double) end as src_lon,
 case when l_partkey % 5 <> 0 then cast(l_partkey % 90 as double) end as dst_lat,
 case when l_partkey % 5 <> 0 then cast(l_partkey % 180 as double) end as dst_lon
from lineitem""",
    # IPv4 ranges with geography
    "b6": """select 3405774848 + cast(n_nationkey as bigint) * 1024 as ip_lo,
 3405774848 + cast(n_nationkey as bigint) * 1024 + 511 as ip_hi, cast(n_nationkey as double) as lat,
 cast(n_nationkey * 2 as double) as lon, n_name as country from nation""",
    # flows between IPv6 hosts, in several ways of writing; a third of them to one host
    "b11": """select l_orderkey as id, case when l_linenumber = 7 then null when l_partkey % 3 = 0 then '2a00:3::5'
  when l_linenumber = 1 then concat('2A00:', lpad(hex(l_partkey % 30), 4, '0'), ':0000:0000:0000:0000:0000:', lpad(hex(l_suppkey % 40), 4, '0'))
  when l_linenumber = 2 then concat('2a00:', lower(hex(l_partkey % 30)), '::', lower(hex(l_suppkey % 40)))
  when l_linenumber = 3 then concat('::ffff:203.0.', cast(l_partkey % 40 as string), '.', cast(l_partkey % 25 as string))
  when l_linenumber = 4 then concat('203.0.', cast(l_partkey % 40 as string), '.', cast(l_partkey % 25 as string))
  when l_linenumber = 5 then concat('fd00::', lower(hex(l_partkey % 30))) else 'x:y::z' end as dst_ip,
 l_linenumber as form, l_partkey % 30 as net, l_suppkey % 40 as host, cast(l_quantity as bigint) as bytes from lineitem""",
    # IPv6 ranges with geography, from a few addresses to a /31
    "b12": """select case n_nationkey % 3 when 2 then concat('2a00', lpad(hex(n_nationkey), 4, '0'), '000000000000000000000003')
  else concat('2a00', lpad(hex(n_nationkey), 4, '0'), repeat('0', 24)) end as ip_lo,
 case n_nationkey % 3 when 0 then concat('2a00', lpad(hex(n_nationkey), 4, '0'), repeat('f', 24))
  when 1 then concat('2a00', lpad(hex(n_nationkey), 4, '0'), '0000000000000000', '0000000f')
  else concat('2a00', lpad(hex(n_nationkey), 4, '0'), '000000000000000000000011') end as ip_hi,
 cast(n_nationkey as double) as lat, 1.5 as lon, n_name as country from nation""",
    # alert rules, also saved searches
    "b7": """select * from (values
 ('r1','auth failures','denied OR failure','text',cast(null as string),'all',300,cast(null as string),
  cast(null as string),true,'2024-01-01'),
 ('r2','blocked flows','reset','text','palo_alto','all',60,null,null,true,'2024-01-02'),
 ('r3','crit regex','critical|fatal|raid','regex',null,'all',600,null,null,true,'2024-01-03'),
 ('r4','nginx errors','error','text',null,'failures_only',300,'/var/log/nginx','app*.log',true,'2024-01-04'),
 ('r5','off','done','text',null,'all',300,null,null,false,'2024-01-05'),
 ('r1','auth failures v2','denied OR "authentication failure"','text',null,'all',300,null,null,true,'2024-02-01'))
 as t(id,name,query,mode,source_type,scope,cooldown_sec,log_dir,file_glob,enabled,updated_at)""",
    # cloud event bodies
    "b8": """select event_id as seq, concat('{"', case event_id % 3 when 0 then 'id' when 1 then 'event_id' else 'other' end, '":"e',
 cast(event_id % 400 as string), '","type":"', upper(event_type), '","message":"m', cast(user_id as string),
 '","timestamp":', cast(case when event_id % 2 = 0 then 1700000000 + event_id else (1700000000 + event_id) * 1000
 end as string), ',"site_name":"s', cast(user_id % 5 as string), '"}') as body from events""",
    # chunk vectors
    "b9": "select cast(label as string) as source, vec_id as start_line, embedding from embeddings",
    # file inventory
    "b10": """select concat('/var/log/', case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then 'nginx/'
  else concat('host', cast(doc_id % 7 as string), '/') end, source, '_', cast(doc_id as string),
  case when doc_id % 5 = 0 then '.log.gz' else '.log' end) as path, n_chars as size_bytes from documents""",
}

_NEEDS = {"b2": ["b1"]}


def with_views(*names: str) -> str:
    """A ``with`` clause that defines the named views for a plain SQL engine."""
    wanted: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in wanted:
                wanted.append(needed)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in wanted) + "\n"


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly parsing of a table that has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Bridge:
    """The views as DataFrames over one data folder. Every property is lazy."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        for field, kind in df.dtypes:
            if kind == "timestamp_ntz":
                df = df.withColumn(field, F.col(field).cast("timestamp"))
        return df

    def view(self, name: str) -> DataFrame:
        tables = {"b4": "orders", "b5": "lineitem", "b6": "nation", "b11": "lineitem", "b12": "nation", "b8": "events", "b9": "embeddings", "b10": "documents"}
        if name in tables:
            source = tables[name]
            text = VIEWS[name].replace(f"from {source}", "from {src}")
        else:
            source, text = "events", VIEWS[name].replace("from events", "from {src}")
        if "{src}" not in text:
            return self.spark.sql(text)
        return self._format(text, self.table(source))

    def _format(self, text: str, src: DataFrame) -> DataFrame:
        name = f"_bridge_src_{id(src):x}"
        src.createOrReplaceTempView(name)
        try:
            return self.spark.sql(text.replace("{src}", name))
        finally:
            self.spark.catalog.dropTempView(name)

    @property
    def events(self) -> DataFrame:
        return self.view("b1")

    @property
    def raw(self) -> DataFrame:
        return spread(self._format(VIEWS["b2"].replace("from b1", "from {src}"), self.events))

    @property
    def line_rows(self) -> DataFrame:
        return spread(self._format(_LINE_ROWS.replace("from events", "from {src}"), self.table("events")))

    @property
    def lines(self) -> DataFrame:
        ranked = running_rank(self.line_rows, ["source"], "id", out="_rank")
        return ranked.select("source", (F.col("_rank") - 1).alias("line_index"), "line", "received_at", "id")

    @property
    def texts(self) -> DataFrame:
        """Free text to be split into lines."""
        docs = spread(self.table("documents"))
        source = F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return docs.select(source.alias("source"), "text", "lang", "doc_id")

    analyses = property(lambda self: self.view("b4"))
    flows = property(lambda self: self.view("b5"))
    ranges = property(lambda self: self.view("b6"))
    flows_6 = property(lambda self: self.view("b11"))
    ranges_6 = property(lambda self: self.view("b12").withColumns({"ip_lo": F.lower("ip_lo"), "ip_hi": F.lower("ip_hi")}))
    rules = property(lambda self: self.view("b7"))
    cloud = property(lambda self: spread(self.view("b8")))
    vectors = property(lambda self: self.view("b9"))
    files = property(lambda self: self.view("b10"))
