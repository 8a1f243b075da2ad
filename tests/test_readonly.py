"""What read-only SQL accepts and refuses, judged on the analysed plan."""

from __future__ import annotations

import pytest

from cairngeo.operators import readonly

HOST = "/etc/hostname"
REFUSED = [
    f"SELECT * FROM IDENTIFIER('text.`{HOST}`')",
    f"SELECT * FROM IDENTIFIER(concat('te', 'xt.`{HOST}`'))",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'currentTimeMillis')",
    "SELECT IDENTIFIER('java_' || 'method')('java.lang.System', 'currentTimeMillis')",
    f"SELECT (SELECT max(value) FROM IDENTIFIER('text.`{HOST}`'))",
    f"SELECT id FROM range(3) WHERE EXISTS (SELECT 1 FROM IDENTIFIER('text.`{HOST}`'))",
    f"SELECT * FROM range(2) r, LATERAL (SELECT value FROM IDENTIFIER('csv.`{HOST}`'))",
    f"SELECT * FROM (WITH x AS (SELECT * FROM binaryFile.`{HOST}`) SELECT * FROM x)",
    f"SELECT 1 UNION ALL SELECT value FROM text.`{HOST}`",
    f"SELECT * FROM json.`file:{HOST}`",
    "SELECT reflect('java.lang.System', 'nanoTime')",
    "SELECT try_reflect('java.lang.System', 'nanoTime')",
    "SELECT system.builtin.reflect('java.lang.System', 'nanoTime')",
    "SELECT id FROM range(3) ORDER BY java_method('java.lang.System', 'nanoTime')",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'nanoTime'))",
    "SELECT sum(id) OVER (ORDER BY reflect('java.lang.System', 'nanoTime')) FROM range(3)",
    "SELECT TRANSFORM(id) USING 'cat' AS (y) FROM range(3)",
    "SELECT calls_back(1)",
]


@pytest.fixture(scope="module")
def named(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("named"))
    spark.range(5).write.parquet(f"{where}/plain")
    spark.sql(f"CREATE DATABASE named_db LOCATION '{where}/db'")
    spark.range(4).write.saveAsTable("named_db.kept")
    spark.read.parquet(f"{where}/plain").createOrReplaceTempView("seen")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW over AS SELECT id + 1 AS id FROM seen")
    spark.sql("CREATE TEMPORARY FUNCTION calls_back(x INT) RETURNS STRING RETURN reflect('java.lang.System', 'lineSeparator')")
    spark.sql("CREATE TEMPORARY FUNCTION twice(x BIGINT) RETURNS BIGINT RETURN 2 * x")
    yield f"{where}/plain"
    for drop in ("VIEW over", "VIEW seen", "TEMPORARY FUNCTION calls_back", "TEMPORARY FUNCTION twice", "TABLE named_db.kept", "DATABASE named_db"):
        spark.sql(f"DROP {drop}")


@pytest.mark.parametrize("text", REFUSED)
def test_refused_before_anything_runs(spark, named, text):
    with pytest.raises(readonly.NotReadOnly):
        readonly.readonly_sql(spark, text)
    with pytest.raises(readonly.NotReadOnly):
        readonly.run(spark, text)


ACCEPTED = {
    "SELECT 1 AS id": [1],
    "SELECT count(*) FROM range(7)": [7],
    "SELECT * FROM VALUES (3), (4) AS v(id)": [3, 4],
    "SELECT max(id) FROM named_db.kept": [3],
    "SELECT sum(id) FROM over": [15],
    "SELECT count(*) FROM given": [6],
    "SELECT count(*) FROM files": [5],
    "SELECT twice(max(id)) FROM seen": [8],
    "SELECT id FROM seen WHERE id IN (SELECT id FROM named_db.kept WHERE id > (SELECT min(id) FROM over))": [2, 3],
    "SELECT a.id FROM seen a JOIN LATERAL (SELECT max(k.id) AS m FROM named_db.kept k WHERE k.id < a.id) ON m = 2 ORDER BY a.id": [3],
    "SELECT x FROM (WITH t AS (SELECT id FROM given) SELECT a.id * b.id AS x FROM t a CROSS JOIN t b) WHERE x = 25": [25],
    "SELECT explode(sequence(1, 2))": [1, 2],
    "SELECT id FROM range(2) UNION ALL SELECT id FROM range(1)": [0, 0, 1],
}


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(spark, named, text):
    given = {"given": spark.range(6), "files": spark.read.parquet(named)}
    assert sorted(r[0] for r in readonly.readonly_sql(spark, text, given).rows.collect()) == ACCEPTED[text]
    left = {t.name for t in spark.catalog.listTables()}
    assert not any(name.startswith("given_") for name in left)


def test_a_given_frame_is_forgotten_when_the_text_is_refused(spark, named):
    with pytest.raises(readonly.NotReadOnly):
        readonly.readonly_sql(spark, "SELECT calls_back(1) FROM given", {"given": spark.range(1)})
    assert not any(t.name.startswith("given_") for t in spark.catalog.listTables())
