from codecairn.operators import secrets, tech
from codecairn.operators.ranking import top_n
from pyspark.sql import functions as F


def stack(df, **kw):
    return tech.tech_stack(df, **kw).first()


def test_npm_override_scope_and_bad_json(spark, files):
    good = '{"dependencies": {"@aws-sdk/client-s3": "1", "express": "4", "@prisma/client": "5"}, "devDependencies": {"express": "5", "@types/x": "1"}}'
    m = tech.find_manifests(files({"package.json": good}), ["npm"])
    deps = [(r.ord, r.dep, r.version) for r in tech.npm_dependencies(m).orderBy("ord").collect()]
    assert deps == [(1, "@aws-sdk/client-s3", "1"), (2, "express", "5"), (3, "@prisma/client", "5"), (4, "@types/x", "1")]
    r = stack(files({"package.json": good, "a.js": ""}))
    assert r.cloud_config == ["AWS SDK"] and r.databases == ["Prisma"] and r.backend_frameworks == ["Express"]
    assert r.languages == ["JavaScript", "TypeScript"] and not r.docker and r.package_managers == []
    for bad in ("{bad", good + "\ntext", good + ", {}", "[1]", "{'dependencies': {'react': '1'}}", '{"dependencies": [1]}'):
        assert tech.npm_dependencies(tech.find_manifests(files({"package.json": bad}), ["npm"])).count() == 0, bad


def test_requirements_and_pyproject(spark, files):
    req = "FastAPI==0.1\n\n# note\nopenai[all]~=1 ; x\r\nfastapi>=2\npsycopg2 "
    got = [r.dep for r in tech.pip_dependencies(tech.find_manifests(files({"requirements.txt": req}), ["pip"])).orderBy("ord").collect()]
    assert got == ["fastapi", "openai", "psycopg2"]
    toml = '[tool.poetry.dependencies]\nDjango = "5"\n[tool.poetry.dev-dependencies]\npytest = "8"\n[project]\ndependencies = ["redis>=5", "flask ; x"]\n'
    got = [r.dep for r in tech.pyproject_dependencies(tech.find_manifests(files({"pyproject.toml": toml}), ["pyproject"])).orderBy("ord").collect()]
    assert got == ["django", "pytest", "redis", "flask"]
    assert stack(files({"pyproject.toml": "not = [toml"})).backend_frameworks == []


def test_manifest_choice(spark, files):
    df = files({"b/package.json": "1", "a/z/package.json": "2", "node_modules/package.json": "3", "Package.json": "4",
                "x/build.gradle": "5", "build.gradle.kts": "6"})
    got = {r.kind: r.path for r in tech.find_manifests(df).collect()}
    assert got == {"npm": "b/package.json", "gradle": "x/build.gradle"}


def test_containers_maven_gradle(spark, files):
    df = files({"docker-compose.yml": "services:\n a:\n  image: Postgres:16\n b:\n  image: my/redis\n", "pom.xml":
                "<artifactId>spring-boot-starter</artifactId><artifactId>mysql-connector</artifactId>", "build.gradle": "Quarkus mongodb"})
    box = tech.container_facts(tech.find_manifests(df)).first()
    assert box.images == ["Postgres:16", "my/redis"]
    r = stack(df)
    assert r.docker and r.backend_frameworks == ["Spring Boot", "Quarkus"]
    assert r.databases == ["MySQL", "MongoDB", "PostgreSQL (pg)", "PostgreSQL", "Redis"] or "PostgreSQL" in r.databases


def test_assumed_languages(spark, files):
    assert stack(files({"a.go": ""})).languages == ["Go"]
    assert stack(files({"a.go": ""}), assume_languages=True).languages == ["Go", "JavaScript", "Python", "Java", "Java/Kotlin"]


def test_ai_words_are_whole_words_and_repo_without_facts_has_a_row(spark, files):
    df = files({"a.py": "import OpenAI, huggingface_hub\nmyopenai", "b.txt": "cohere"}).union(files({"x.zzz": ""}, "empty"))
    assert {(r.repo_id, r.label) for r in tech.ai_source_hits(df).collect()} == {("r", "OpenAI"), ("r", "HuggingFace Hub")}
    assert {r.repo_id for r in tech.tech_stack(df).collect()} == {"r", "empty"}


SAMPLES = {
    "Generic Secret Assignment": 'Password: "hunter2hunter2"',
    "AWS Access Key ID": "id AK" + "IA" + "ABCDEFGHIJKLMNOP.",
    "GitHub Token": "gh" + "p_" + "a" * 36,
    "Private Key": "-----BEGIN RSA PRIV" + "ATE KEY-----\nMIIabc\n-----END",
    "JSON Web Token": "ey" + "Jabcdefghij.abcdefghij.abcdefghij",
    "URL With Password": "postgres://app:pw1@db/x",
    "Slack Token": "xo" + "xb-1234567890-abc",
    "Environment Assignment": "A=1\nSERVICE_TOKEN=abcdefgh12\n",
}


def test_every_rule_finds_and_masks(spark, files):
    assert set(SAMPLES) == {r.name for r in secrets.RULES}
    df = files({name: text for name, text in SAMPLES.items()} | {"clean": "no token here, key: short"})
    found = {r.file: r.secret_types for r in secrets.scan_secrets(df).collect()}
    assert found == {n: [n] for n in SAMPLES}
    again = secrets.mask_secrets(df, "content").select("repo_id", "path", F.col("masked").alias("content"))
    # The header of a key and the mask inside a URL stay recognisable; everything else is gone.
    assert {r.file for r in secrets.scan_secrets(again).collect()} == {"Private Key", "URL With Password"}
    masked = {r.path: r.content for r in again.collect()}
    assert masked["URL With Password"] == "postgres://app:****@db/x" and masked["clean"] == "no token here, key: short"


def test_hints_never_hide_a_match(spark, files):
    for rule in secrets.RULES:
        for text in SAMPLES.values():
            df = files({"f": text})
            with_hint = df.select(secrets._matches(F.col("content"), rule)).first()[0]
            assert with_hint == df.select(F.col("content").rlike(rule.pattern)).first()[0]


def test_secrets_report(spark, files):
    df = files({f"f{i:02}.py": 'token = "abcdefgh12"' for i in range(12)} | {"a": SAMPLES["Slack Token"], "ok": ""})
    r = secrets.secrets_report(secrets.scan_secrets(df), df).first()
    assert (r.total_files_scanned, r.files_with_secrets, r.high_risk_count) == (14, 13, 1)
    assert r.secret_types_found == ["Generic Secret Assignment", "Slack Token"]
    assert [f.file for f in r.findings] == ["a"] + [f"f{i:02}.py" for i in range(9)]


def test_large_top_n_is_exact(spark):
    df = spark.range(20000).selectExpr("id % 3 as g", "(id * 7919) % 20011 as v").repartition(6)
    got = top_n(df, ["g"], [F.col("v")], 1500)
    want = {g: sorted((i * 7919) % 20011 for i in range(20000) if i % 3 == g)[:1500] for g in range(3)}
    for g in range(3):
        assert [r.v for r in got.filter(f"g = {g}").orderBy("rank").collect()] == want[g]


def test_whole_private_key_is_masked(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\nabc-def\n-----END RSA PRIVATE KEY-----\nafter"
    cut = "-----BEGIN PGP PRIVATE KEY BLOCK-----\nbody-without-end"
    env = "A=1\nexport API_KEY=abcd1234efgh\nSECRET=short"
    df = spark.createDataFrame([(1, key), (2, cut), (3, env)], "i int, t string")
    got = {r.i: r.masked for r in secrets.mask_secrets(df, "t").collect()}
    assert got[1] == "-----BEGIN RSA PRIVATE KEY-----****-----END RSA PRIVATE KEY-----\nafter"
    assert got[2] == "-----BEGIN PGP PRIVATE KEY BLOCK-----****"
    assert got[3] == "A=1\nexport API_KEY=****\nSECRET=short"


def test_spans_of_all_rules_are_masked_once(spark):
    """Rules that overlap: the union of their spans on the text as it is, whatever the order of rules; masks stay as they are."""
    import itertools
    import random
    r = random.Random(2)
    pieces = ["password = 'postgres://u:secretpw@h/x'", "AKIA" + "ABCDEFGHIJKLMNOP", "token: \"" + "xo" + "xb-1234567890-abc\"", "MY_SECRET_KEY=abcdefgh1", " ", "\n", "é 日 ",
              "-----BEGIN RSA PRIVATE KEY-----\nsecret='abcdefghij'\n-----END RSA PRIVATE KEY-----", "ftp://a:" + "AKIA" + "ABCDEFGHIJKLMNOP@host", "key='12345678", "'", "\x02", "plain"]
    texts = ["", None, *("".join(r.choice(pieces) for _ in range(r.randrange(1, 9))) for _ in range(120))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x for x in df.select("i", "t", secrets.secret_spans(F.col("t")).alias("s"), secrets.mask_text(F.col("t")).alias("m"),
                                     secrets.mask_text(F.col("t"), secrets.RULES[::-1]).alias("back")).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        if t is None:
            assert x.m is None
            continue
        assert all(a.end <= b.start for a, b in itertools.pairwise(x.s)) and all(s.start < s.end <= len(t) for s in x.s)
        out, at = "", 0
        for s in x.s:
            out, at = out + t[at:s.start] + "****", s.end
        assert x.m == x.back == out + t[at:]
    again = spark.createDataFrame([(i, x.m) for i, x in got.items()], "i int, t string").select("t", secrets.mask_text(F.col("t")).alias("m"))
    assert all(a.t == a.m for a in again.collect())
    hidden = ["secretpw", "ABCDEFGHIJKLMNOP", "1234567890-abc", "abcdefghij"]
    whole = "\n".join(pieces[:4] + pieces[7:9])
    masked = spark.createDataFrame([(whole,)], "t string").select(secrets.mask_text(F.col("t"))).first()[0]
    assert not any(h in masked for h in hidden)
