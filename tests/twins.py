"""What the tests share; the name is found in no other tests folder."""

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame, columns):
    """Rows of a pandas frame as sorted text, numbers to nine digits."""

    def text(v):
        if v is None or v != v or str(v) in ("NaT", "<NA>"):
            return ""
        if isinstance(v, float):
            return f"{v:.9g}"
        if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
            return str([text(x) for x in v])
        return str(v)

    return sorted(tuple(text(float(v) if k in floats else v) for k, v in zip(columns, row)) for floats in [{c for c in columns if frame[c].dtype.kind == "f"}] for row in frame[columns].itertuples(index=False))


def same(spark_frame, duck_frame):
    columns = sorted(spark_frame.columns)
    assert columns == sorted(duck_frame.columns)
    for c in columns:  # a null makes whole numbers floats in pandas
        if spark_frame[c].dtype.kind != duck_frame[c].dtype.kind and {spark_frame[c].dtype.kind, duck_frame[c].dtype.kind} <= set("iuf"):
            spark_frame[c], duck_frame[c] = spark_frame[c].astype(float), duck_frame[c].astype(float)
    assert canonical(spark_frame, columns) == canonical(duck_frame, columns)
