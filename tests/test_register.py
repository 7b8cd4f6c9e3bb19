"""SQL functions give what the Column functions give."""

from pyspark.sql import functions as F

from docweir.functions import register


def test_sql_functions_equal_columns(spark):
    names = register.register_functions(spark, "dw_")
    values = ["1995-03-15", "31503950012345", "Aliyev Sho'h A", "1500000", "D23145890", '```json\n{"a": 1}\n```', "ЁЛКА, (x) -> 'q'", "", "<<A<B"]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value string")
    df.createOrReplaceTempView("dw_values")
    for name in names:
        fn = register.FUNCTIONS[name[3:]][0]
        mine = df.select("value", fn(F.col("value")).alias("x")).collect()
        sql = spark.sql(f"SELECT value, {name}(value) AS x FROM dw_values").collect()
        assert sorted(map(str, mine)) == sorted(map(str, sql)), name
