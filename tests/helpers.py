from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def quarter(i, start=START):
    return start + timedelta(minutes=15 * i)


def series(spark, values, start=START, asset="a", value="demand_mw", step=15):
    rows = [(asset, start + timedelta(minutes=step * i), None if x is None else float(x)) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, f"asset_id string, timestamp timestamp, {value} double")


def ordered(df, *columns, by=("timestamp",)):
    rows = df.orderBy(*by).select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]
