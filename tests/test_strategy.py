import duckdb
import pytest
from compare import same

from gleanery.plans import registry

TAILS = ["", "é", "é b c", "ñ a b c d e f g h i j k l m n o", "_ b c", " b c", ". b c", ".b c", "\u0085b c d", "\x0bb c d", "\xa0b c", "ſ b c", "\r", '"', '\r"', "\u2028\"", " d\te f"]
HEADS = ["do", "Do", "iſ", "who", "isé", "x versus", "x verſus", "x éversus", "x vs", "x trade-off", "ıs", "İs", '"a b', "aſk", "liKe design", "x deſign"]
TEXTS = [h + t for h in HEADS for t in TAILS]


@pytest.mark.parametrize("name", ["strategy_classify", "auto_expand"])
def test_edges_cases_and_blanks_as_sql_reads_them(name, spark, tmp_path):
    # seven ids a text, so that it stands undressed too
    rows = [(7 * i + k, t) for i, t in enumerate(TEXTS) for k in range(7)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(registry.queries()[name](spark, str(tmp_path)), duck, registry.oracle_sql()[name])
