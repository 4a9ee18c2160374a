"""A corpus of projects derived from the ``documents`` and ``part`` tables.

Each document becomes one file: its whole text, then some lines of code of the kind its
number selects. Each part becomes one line of an env file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Of the directories of the corpus, the one that audits leave out.
IGNORE = ("gen",)

# One-element explodes: later tests of path and content see columns, as with a stored table,
# and not copies of these expressions.
_PATH = """explode(array(concat(project, CASE kind
  WHEN 0 THEN concat('/pkg/f', doc_id, '.js')
  WHEN 1 THEN concat('/pkg-a/f', doc_id, '.ts')
  WHEN 2 THEN concat('/cmd/f', doc_id, '.go')
  WHEN 3 THEN concat('/pkg.py/f', doc_id, '.py')
  WHEN 4 THEN concat('/svc', doc_id, '/Dockerfile')
  WHEN 5 THEN concat('/deploy/f', doc_id, '.dockerfile')
  WHEN 6 THEN concat('/vendor/f', doc_id, '.js')
  WHEN 7 THEN concat('/docs/f', doc_id, '.md')
  WHEN 8 THEN concat('/Dockerfile.f', doc_id, '.py')
  ELSE concat('/gen/f', doc_id, '.ts') END))) AS path"""

# '$' and '{' stay apart: SQL text with both in a row is taken for a substitution.
_CONTENT = """explode(array(concat(text, chr(10), CASE
  WHEN kind IN (0, 1, 6, 9) THEN concat(
    'const a = process.env.', v1, '; f(process.env["', v2, '"], process.env[''', v1, ''']);',
    chr(13), chr(10), 'process.env[key]; process.env.Mixed; process.env.lower', chr(10))
  WHEN kind = 2 THEN concat(
    'a := os.Getenv("', v1, '")', chr(10),
    'b, ok := os.LookupEnv("', v2, '"); os.Getenv(name)', chr(10))
  WHEN kind = 3 THEN concat(
    'a = os.getenv("', v1, '"); b = os.environ[''', v2, ''']', chr(10),
    'c = os.environ["', v1, '"]; os.getenv("', v2, '", "x")')
  WHEN kind IN (4, 5, 8) THEN concat(
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('from node AS b', chr(10)) END,
    'ENV ', v1, '=1 ', chr(92), ' ', chr(10), '    D_', v2, '=2 lower=3', chr(10),
    'ARG B_', v1, '=x', chr(10), 'ENV ', v2, ' plain', chr(10), '# $COMMENTED', chr(10),
    'RUN echo $', v1, ' $', '{', v1, '} $', '{U_', v2, ':-d} $', v2)
  ELSE 'process.env.IGNORED_MD' END,
  CASE WHEN doc_id % 97 = 5 THEN concat(chr(10), repeat('x', 70000)) ELSE '' END))) AS content"""


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .selectExpr("doc_id", "source AS project", "text", "(doc_id div 20) % 10 AS kind")
        .selectExpr(
            "*",
            "concat('VAR_', CAST((doc_id * 7) % 61 AS STRING)) AS v1",
            "concat('VAR_', CAST((doc_id * 11 + 3) % 59 AS STRING)) AS v2",
        )
        .selectExpr("*", _PATH)
        .selectExpr("project", "path", _CONTENT)
    )


def corpus_env_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three env files per project, each of distinct lines, of which there are 50 at most."""
    lines = (
        spark.read.parquet(f"{sf_dir}/part.parquet")
        .selectExpr(
            "p_partkey",
            "concat('src', CAST(p_partkey % 20 AS STRING)) AS project",
            "(p_partkey div 20) % 3 AS kind",
            "(p_partkey div 60) % 50 AS n",
        )
        .selectExpr(
            "project",
            "kind",
            "p_partkey",
            """CASE WHEN n % 9 = 4 THEN concat('# VAR_', n, '=off')
                    WHEN n % 9 = 7 THEN concat('export VAR_', n, '=1')
                    WHEN n % 9 = 8 THEN concat('var_', n, '=1')
                    ELSE concat(CASE WHEN n % 2 = 0 THEN '  ' ELSE '' END, 'VAR_', n, ' =a=b')
               END AS line""",
        )
        .groupBy("project", "kind", "line")
        .agg(F.min("p_partkey").alias("first_part"))
    )
    texts = lines.groupBy("project", "kind").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_part", "line"))), lambda x: x["line"]
            ),
            "\n",
        ).alias("text")
    )
    return texts.selectExpr(
        "project",
        "CAST(kind AS INT) AS ordinal",
        "CASE kind WHEN 0 THEN '.env' WHEN 1 THEN '.env.local' ELSE '.env.production' END AS env_path",
        """CASE WHEN project = 'src7' OR (project = 'src3' AND kind = 2)
           THEN CAST(NULL AS STRING) ELSE text END AS content""",
    )
