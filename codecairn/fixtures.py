"""Input views derived from the test tables, as SQL text that Spark and DuckDB both run.

The test tables hold no source code, so repositories, generated sections, projects and a
status log are derived from ``documents``, ``conversations`` and ``events``. See FIXTURES.md.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.vocab import SECTION_NAMES
from .sources.tables import read_table

FILES_SQL = """
SELECT concat(source, '-', CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR(20))) AS repo_id,
  concat(CASE WHEN source = 'src3' THEN 'top/' ELSE '' END,
    CASE doc_id % 13 WHEN 0 THEN 'src/routes/' WHEN 1 THEN 'src/models/' WHEN 2 THEN 'web/components/'
      WHEN 3 THEN 'web/pages/' WHEN 4 THEN 'server/services/' WHEN 5 THEN 'server/api/auth/'
      WHEN 6 THEN 'tests/unit/' WHEN 7 THEN 'docs/' WHEN 8 THEN 'node_modules/pkg/'
      WHEN 9 THEN 'src/prompts/' WHEN 10 THEN 'migrations/' WHEN 11 THEN 'build/' ELSE '' END,
    CASE doc_id % 16 WHEN 0 THEN 'main.py' WHEN 1 THEN 'index.ts' WHEN 2 THEN 'package.json'
      WHEN 3 THEN 'README.md' WHEN 4 THEN 'Dockerfile' WHEN 5 THEN 'requirements.txt'
      WHEN 6 THEN concat('View', CAST(doc_id AS VARCHAR(20)), '.tsx')
      WHEN 7 THEN concat('user_', CAST(doc_id AS VARCHAR(20)), '.py')
      WHEN 8 THEN concat('auth_', CAST(doc_id AS VARCHAR(20)), '.js')
      WHEN 9 THEN 'docker-compose.yml' WHEN 10 THEN 'pyproject.toml' WHEN 11 THEN 'pom.xml'
      WHEN 12 THEN 'build.gradle' WHEN 13 THEN '.env.example' WHEN 14 THEN 'schema.prisma'
      ELSE concat('mod_', CAST(doc_id AS VARCHAR(20)), '.go') END) AS path,
  CASE
    WHEN doc_id % 16 = 2 AND doc_id % 5 <> 0 THEN concat('{"description": "', replace(replace(text, '"', ' '), chr(10), ' '),
      '", "dependencies": {"react": "^18", "express": "^4", "@prisma/client": "5", "@aws-sdk/client-s3": "3", "left-pad-',
      CAST(doc_id % 7 AS VARCHAR(20)), '": "1"}, "devDependencies": {"jest": "29", "express": "^5", "@types/node": "20"}}')
    WHEN doc_id % 16 = 2 THEN concat('{"dependencies": {"react": "^18"}}', chr(10), text)
    WHEN doc_id % 16 = 10 THEN concat_ws(chr(10), '[project]', 'dependencies = ["flask>=3", "pytest"]',
      '[tool.poetry.dependencies]', concat('motor = "', CAST(doc_id % 7 AS VARCHAR(20)), '"'),
      concat('# ', replace(text, chr(10), concat(chr(10), '# '))))
    ELSE concat_ws(chr(10),
      CASE WHEN doc_id % 16 = 5 THEN concat_ws(chr(10), 'fastapi==0.1', 'SQLAlchemy>=2', '# note', 'openai[all]~=1.0', concat('pkg', CAST(doc_id % 7 AS VARCHAR(20)), '<2'))
      WHEN doc_id % 16 = 9 THEN concat_ws(chr(10), 'services:', '  db:', '    image: postgres:16', '  cache:', '    image: redis:7')
      WHEN doc_id % 16 = 11 THEN '<project><artifactId>spring-boot-starter</artifactId><artifactId>mysql-connector</artifactId></project>'
      WHEN doc_id % 16 = 12 THEN 'implementation "io.quarkus:quarkus-core:3"'
      WHEN doc_id % 16 = 13 THEN concat_ws(chr(10), concat('DATABASE_URL=postgres://app:pw', CAST(doc_id % 9 AS VARCHAR(20)), '@db/main'), concat('CLOUD_ID=AK', 'IA', 'ABCDEFGHIJKLMNO', CAST(doc_id % 10 AS VARCHAR(20))))
      WHEN doc_id % 16 = 14 THEN concat('model Item', CAST(doc_id % 5 AS VARCHAR(20)), ' {', chr(10), '}')
      WHEN doc_id % 16 IN (0, 7) THEN concat_ws(chr(10), concat('import os, mod', CAST(doc_id % 9 AS VARCHAR(20)), ' as m'), 'from app.models import User', concat('@router.get("/items/', CAST(doc_id % 6 AS VARCHAR(20)), '")'), concat('class Model', CAST(doc_id % 4 AS VARCHAR(20)), '(Base):'), concat('requests.get("https://api', CAST(doc_id % 3 AS VARCHAR(20)), '.example.com/v1")'), 'db.session.commit()', concat('httpx.post("https://hook.example.com/', CAST(doc_id % 2 AS VARCHAR(20)), '")'), concat('@bp.route("/f', CAST(doc_id % 4 AS VARCHAR(20)), '")'), 'urlpatterns = [path("admin/", v)]', 'from app.models import Item', '# see (', 'import sys', 's = "("', 'from late import (a)', 'requests.get(', '', '  "https://late.example.com/v1")', 'y = f(x', 'import after')
      WHEN doc_id % 16 IN (1, 6, 8) THEN concat_ws(chr(10), 'import a from ''react''', concat('const b = require("./mod_', CAST(doc_id % 9 AS VARCHAR(20)), '")'), concat('app.post(''/api/r', CAST(doc_id % 6 AS VARCHAR(20)), ''', h)'), concat('fetch(''/api/r', CAST((doc_id + 1) % 6 AS VARCHAR(20)), ''')'), 'import { x } from "openai"', concat('const L = import("./lazy_', CAST(doc_id % 3 AS VARCHAR(20)), '")'), concat('await axios', chr(10), '  .put(', chr(10), '`/api/r/', chr(36), '{id}`, b)'), 'import r2 from ''react''', '// call fetch(', 'import late from "late"', concat('router', chr(10), '.get(''/late'', h)'))
      ELSE '' END,
      text) END AS content
FROM documents
"""

# One generation run holds at most nine sections, one per section name.
SECTIONS_SQL = """
SELECT concat('src', CAST(conv_id % 20 AS VARCHAR(20)), '-0') AS repo_id,
  concat('run-', CAST(conv_id AS VARCHAR(20)), '-', CAST(CAST(floor(turn / 9) AS BIGINT) AS VARCHAR(20))) AS run_id,
  CASE turn % 9 {names} END AS section,
  concat_ws(chr(10), text,
    concat('**Step ', CAST(turn + 1 AS VARCHAR(20)), ' — open `item` ', CAST(conv_id AS VARCHAR(20)), '**'),
    concat('- **File**: `', CASE (conv_id + turn) % 6 WHEN 0 THEN 'web/pages/View3.tsx' WHEN 1 THEN 'src/routes/main.py'
      WHEN 2 THEN 'server/services/index.ts' WHEN 3 THEN 'src/models/schema.prisma' WHEN 4 THEN 'ghost/none.py'
      ELSE 'integrations/client.go' END, '`'),
    CASE turn % 4 WHEN 0 THEN 'Confidence: Confirmed [Repository-Evidence]' WHEN 1 THEN 'Confidence: Inferred [Inferred]'
      WHEN 2 THEN 'Confidence: Unclear version 1.5' ELSE 'Confidence: Missing [User-Provided]' END) AS markdown
FROM conversations
""".replace("{names}", " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SECTION_NAMES)))

STATUS_LOG_SQL = """
SELECT user_id AS project_id, ts,
  CASE event_type WHEN 'signup' THEN 'extracted' WHEN 'view' THEN 'analyzing:tech' WHEN 'click' THEN 'analyzed'
    WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE concat('custom:', event_type) END AS status, event_id
FROM events
"""

PROJECTS_SQL = """
SELECT repo_id,
  CASE n % 5 WHEN 0 THEN 'beginner' WHEN 1 THEN 'product' WHEN 2 THEN 'developer' WHEN 3 THEN 'expert' END AS technical_level,
  CASE WHEN n % 3 = 0 THEN NULL ELSE concat('Product of ', repo_id) END AS product_description,
  CASE WHEN n % 2 = 0 THEN NULL ELSE concat('Features of ', repo_id) END AS important_features
FROM (SELECT concat(source, '-', CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR(20))) AS repo_id,
        min(doc_id) AS n FROM documents GROUP BY 1) AS p
"""

# Text a model might answer for one important file; some answers are not JSON.
ANSWER_SQL = """CASE WHEN length(path) % 5 = 0 THEN concat('  No JSON about ', path, ' ')
  ELSE concat('{"responsibility": "Owns ', path, '", "important_symbols": ["s1", "s2", "s3", "s4", "s5", "s6", "s7"], "inputs": "in ',
    CAST(rank AS VARCHAR(20)), '", "outputs": "out", "connections": [', CASE WHEN length(path) % 3 = 0 THEN ''
    ELSE '"c1", "c2", "c3", "c4", "c5"' END, '], "evidence_snippet": "line one', chr(92), 'nline two"}') END"""

# Text a model might answer for the plan of one repository.
PLAN_ANSWER_SQL = """CASE WHEN length(repo_id) % 2 = 0 THEN concat('sorry, no plan for ', repo_id)
  ELSE concat('{"major_modules":[{"name":"core","description":"Core of ', repo_id, '","files":["main.py"]}],',
    '"explanation_order":[', '{"step":1,"component":"a","reason":"r1"},{"step":2,"component":"b","reason":"r2"},',
    '{"step":3,"component":"c","reason":"r3"},{"step":4,"component":"d","reason":"r4"},',
    '{"step":5,"component":"e","reason":"r5"},{"step":6,"component":"f","reason":"r6"}],',
    '"main_user_flow_target":"open item","required_diagrams":["flow"],"concepts_needing_analogies":[],',
    '"uncertain_areas":["deployment"]}') END"""


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str, source: DataFrame | None = None) -> DataFrame:
    (source if source is not None else read_table(spark, f"{sf_dir}/{table}.parquet", int(spark.conf.get("codecairn.spread", "0")) or None)).createOrReplaceTempView(table)
    return spark.sql(sql)


def files(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """``documents`` may be a streaming frame of the same columns."""
    return _view(spark, sf_dir, "documents", FILES_SQL, documents)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "conversations", SECTIONS_SQL)


def status_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    return _view(spark, sf_dir, "events", STATUS_LOG_SQL, events)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "documents", PROJECTS_SQL)
