"""Table functions called in SQL, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.functions import tables
from shelfspark.plans.registry import query, table

_SUM13 = " + ".join(f"cast(substr(b, {i}, 1) as int) * {1 if i % 2 else 3}" for i in range(1, 13))


@query("isbn_rows_of_pages", f"""
with k as (select page_id, '978' || lpad(cast(page_id as varchar), 9, '0') as b, contains(html, '<b>') as hard, length(html) as n from pages),
i as (select *, b || cast((10 - ({_SUM13}) % 10) % 10 as varchar) as isbn from k)
select page_id, isbn, 'volumen' as role, n::int as number from i
union all select page_id, isbn, case when hard then 'tapa_dura' else 'ebook' end, null from i
""")
def isbn_rows_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Two labelled numbers behind the text of each page: its length as a volume, and a binding that depends on its markup."""
    tables.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("_udtf_pages")
    sums = _SUM13.replace("cast(substr(b", "cast(substring(b")
    return spark.sql(f"""
        with k as (select page_id, html, '978' || lpad(cast(page_id as string), 9, '0') as b from _udtf_pages),
        i as (select *, b || cast((10 - ({sums}) % 10) % 10 as string) as isbn from k),
        t as (select page_id, html || ' ISBN ' || isbn || ' (Vol. ' || length(html) || '), ISBN-13: ' || isbn || case when contains(html, '<b>') then ' (hardcover)' else ' (ePub, pdf)' end as text from i)
        select t.page_id, r.isbn, r.role, r.number from t, lateral isbn_rows(t.text) r""")


@query("cip_rows_of_parts", "select p_partkey, 'title' as kind, p_name as value from part union all select p_partkey, 'subject', p_type from part")
def cip_rows_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks written from parts, read back as rows."""
    tables.register(spark)
    table(spark, d, "part").createOrReplaceTempView("_udtf_part")
    return spark.sql(r"""
        select p.p_partkey, r.kind, r.value from _udtf_part p, lateral cip_rows('Library of Congress Cataloging-in-Publication Data\n' || p_name || ' / by someone.\n p. cm.\n1. ' || p_type || '. I. Title.\n') r
        where r.kind in ('title', 'subject')""")
