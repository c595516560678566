from oracle import connect, rows


def connect_rows(spark, tables, query, sql):
    ours, theirs = query(spark, tables).toPandas(), connect(tables).sql(sql).df()
    assert rows(ours) == rows(theirs)
