import json
from datetime import date
from decimal import Decimal

import pytest

from cdsloom import catalogue
from cdsloom.operators import certainty, graph, metrics
from cdsloom.operators.tree import tree
from cdsloom.plans.compile import body, frame, literal, statement
from cdsloom.plans.guard import NotAllowed, check, read
from cdsloom.plans.names import Settings, cleaned, folder
from cdsloom.plans.syntax import parse
from cdsloom.session import Session, export_certainty, save, saved

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def read_table(spark):
    def run(name):
        return spark.read.parquet(f"{SMALL}/{name.lower()}.parquet")

    return run


@pytest.mark.parametrize("junk", ["", "@@@", "define view", "{{{{", None, "define view x as select from t { a", "define view x as select 'open from t", "))", "define view x as select a from", "@a: { b"])
def test_junk_is_truncated(junk):
    v = parse("X", junk)
    assert v.truncated and not v.parsed and v.advisories


def test_metadata_and_items():
    v = parse("Z", "@AbapCatalog.sqlViewName: 'ZSQL'\n@EndUserText.label: 'It''s @x'\ndefine root view entity Z_E as select from bsas as b { key b.bukrs as Code, @Semantics.x: #Y b.dmbtr } where b.a = 'x  y' -- no\n")
    assert (v.sql_view, v.label, v.entity, v.kind) == ("ZSQL", "It's @x", "Z_E", "root view entity")
    block = v.blocks[0]
    assert (block.base, block.alias, [i.key for i in block.items]) == ("bsas", "b", [True, False])
    assert block.where[-1].text == "'x  y'" and not v.advisories


def test_unsupported_kinds():
    for kind in ("table function", "hierarchy", "abstract entity", "custom entity"):
        v = parse("Z", f"define {kind} Z {{ a : b; }}")
        assert not v.truncated and not v.parsed and v.advisories


@pytest.mark.parametrize("name", [n for n in catalogue.VIEWS if n not in ("v_parameter", "v_parameter_types", "v_dats_add_days", "v_assoc_multihop", "v_assoc_filtered_inner", "v_stacked")])
def test_text_and_plan_agree(spark, read_table, name):
    view = parse(name, catalogue.VIEWS[name][0])
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        read_table(t).createOrReplaceTempView(t)
    planned, text = frame(view, read_table), spark.sql(body(view, lambda n: n))
    assert planned.columns == text.columns
    assert sorted(map(str, planned.collect())) == sorted(map(str, text.collect()))


def test_pushdown(spark, read_table):
    plan = frame(parse("Z", catalogue.VIEWS["v_project_filter"][0]), read_table)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30" in plan and "l_comment" not in plan


def test_unused_association_isn_t_joined(read_table):
    view = parse("Z", catalogue.VIEWS["v_assoc_unused"][0])
    assert "JOIN" not in body(view, lambda n: n) and any("isn't used" in a for a in view.advisories)


def test_statement_is_commented():
    s = statement(parse("Z", "define view Z as select a from t"), lambda n: f"c.s.{n}", "c.t.z")
    assert "-- CREATE OR REPLACE VIEW c.t.z AS" in s and "FROM c.s.t AS t" in s
    assert statement(parse("Z", "no"), str, "x").startswith("-- ") and "\n" not in statement(parse("Z", "no"), str, "x")


@pytest.mark.parametrize("sql,ok", catalogue._STATEMENTS)
def test_guard(spark, sql, ok):
    if ok:
        check(spark, sql)
    else:
        with pytest.raises(NotAllowed):
            read(spark, sql)


def test_exact_class(spark):
    cases = {
        "define view a as select from t { x }": "COMPLETA_FECHA_CHAVE", "define view a as select from t { x } where y = 'a}": "TRUNCADO_LITERAL_ABERTO", "define view a as select from t { x } /* c": "TRUNCADO_COMENTARIO_ABERTO",
        "define view a as select from t { x } where y = '}{' // }": "COMPLETA_COM_SUFIXO", "define view a as select from t { x": "TRUNCADO_CHAVE_ABERTA", "define view a as select x from t": "COMPLETA_SEM_CHAVES",
        "define view a as select x from": "TRUNCADO_SEM_CHAVES", "a } {}": "CHAVES_NEGATIVAS", "define view a as select from t { x } where": "TRUNCADA_NO_SUFIXO", "define view a { x } hm": "SUFIXO_NAO_RECONHECIDO",
        "x { 'it''s' } where y = 1": "COMPLETA_COM_SUFIXO", "'" + "a''" * 9000 + "' {}": "COMPLETA_FECHA_CHAVE",
    }
    df = metrics.with_exact_class(spark.createDataFrame(list(cases), "string").toDF("t"), "t")
    assert {r.t: r.classe_exata for r in df.collect()} == cases


def test_reachability_with_cycle_and_diamond(spark):
    link = spark.createDataFrame([("B", "A"), ("C", "A"), ("D", "B"), ("D", "C"), ("A", "D"), ("Y", "X")], "child string, parent string")
    assert {r.name for r in graph.reached(link, spark.createDataFrame([("B",)], "name string")).collect()} == {"A", "B", "C", "D"}


def test_session(spark, read_table, tmp_path):
    sources = {"z_root": "define view Z_R as select from ZMID as m inner join orders as o on o.o_orderkey = m.Id { m.Id, o.o_orderstatus as S }", "zmid": "define view ZX as select o_orderkey as Id from orders where o_orderkey < 100", "bad": "define view B as select from t { a", "loop": "define view entity L as select from loop { a }"}
    s = Session(spark, sources, tables=read_table)
    r = s.translate("Z_ROOT", run=True, write_to=str(tmp_path))
    assert r.generated and r.seal() == "clean" and r.df.count() == read_table("orders").where("o_orderkey < 100").count()
    assert [x["tipo"] for x in r.tree.rows] == ["CDS", "CDS", "TABELA", "TABELA"] and r.tree.tables == {"ORDERS"}
    assert {p.name for p in (tmp_path / "Z_ROOT").iterdir()} == {"z_root.sql", "arvore.txt", "metadata.json"}
    assert "platform_dev.sap_s4_nc2_replica.zmid" in r.sql and "platform_dev.sap_s4_nc2_raw.orders" in r.sql
    assert not s.translate("nope").found and s.translate("bad").seal() == "not generated"
    assert [x["tipo"] for x in s.tree("loop").rows] == ["CDS", "CICLO"]
    assert s.translate("ZX").found and s.exists("zmid") and s.source("ZMID").startswith("define")
    assert "advisories" in save(s.translate("bad"), str(tmp_path), dry=True) and not (tmp_path / "BAD").exists()
    assert {r.ddlname: r.motivo for r in s.inventory().collect()}["BAD"] == "FONTE_TRUNCADO"
    c = s.certainty(s.sources)
    assert {r.ddlname for r in certainty.guaranteed(c).collect()} == {"Z_ROOT", "ZMID", "LOOP"} and certainty.failed(c).count() == 1


def test_tree_limits():
    views = {f"V{k}": parse(f"V{k}", f"define view V{k} as select from V{k + 1} as a join V{k + 1} as b on a.x = b.x {{ a.x }}") for k in range(9)}
    lookup = lambda n: views.get(n.upper())
    assert "LIMITE" in {r["tipo"] for r in tree("V0", lookup, depth=3).rows}
    assert tree("V0", lookup, nodes=4).rows[-1]["tipo"] == "LIMITE_GLOBAL"
    assert tree("V0", lookup).tables == {"V9"}


def test_names():
    assert cleaned(" /NS/Name ") == "ns_name" and folder("/a/b c:") == "A_B_C_" and folder("/") == "SEM_NOME"
    assert Settings.from_dict({"raw_schema": "s", "other": "x"}).sources_table == "platform_dev.s.tab_ddddlsrc"


def test_session_asks_a_job_for_each_level(spark, read_table):
    sources = {f"V{k}": f"define view E{k} as select from {'E' if k % 2 else 'V'}{k + 1} as a {{ a.x }}" for k in range(12)} | {"V12": "define view E12 as select o_orderkey as x from orders"}
    s = Session(spark, sources, tables=read_table)
    s.named  # noqa: B018  written once

    def jobs(call):
        spark.sparkContext.setJobGroup("count", "count")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("count"))
        result = call()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup("count")) - before

    tree_, n = jobs(lambda: s.tree("V0"))
    assert n <= 14 and [r["tipo"] for r in tree_.rows] == ["CDS"] * 13 + ["TABELA"] and tree_.tables == {"ORDERS"}
    again, n = jobs(lambda: s.translate("V0", run=True))
    # One job: what reading the table's schema takes.
    assert n <= 1 and again.df.columns == ["x"] and again.df.count() == read_table("orders").count()


def test_session_inventory_feeds_trees_and_certainty(spark, read_table):
    tail = '/*+[internal] {"FROM":["%s"]} */'
    sources = {
        "ROOT": "define view R as select from MID as m { m.a }" + tail % "MID", "MID": "define view M as select from t { a } where" + tail % "T",
        "FREE": "define view F as select from region { r_name }" + tail % "REGION", "FN": "define table function FN returns { a : b; } implemented by method C=>M;",
    }
    s = Session(spark, sources, tables=read_table)
    assert [r["tipo"] for r in s.tree("ROOT").rows] == ["CDS", "CDS", "TABELA"]
    found = {r.ddlname: r.motivo for r in s.inventory().collect()}
    assert found == {"ROOT": "DEPENDENCIA_QUEBRADA", "MID": "FONTE_TRUNCADO", "FREE": "APTA", "FN": "TIPO_NAO_AMDP"}
    t = s.tree("ROOT")
    assert [r["tipo"] for r in t.rows] == ["CDS", "TRUNCADO", "AVISO"] and t.truncated == {"MID"} and t.has_problem
    assert [r.ddlname for r in s.certainty().collect()] == ["FREE"] and s.certainty(spark.createDataFrame([(" root ",)], "ddlname string")).count() == 1
    assert "1 of 4 apt, 1 truncated" in graph.summary(s.found) and "FONTE_TRUNCADO" in graph.summary(s.found)


def test_analysed_is_the_third_tier(spark, read_table):
    s = Session(spark, {"A": "define view A as select r_nothing as x from region", "B": "define view B as select r_name as x from region"}, tables=read_table)
    a, b = (s.translate(n, analyse=True) for n in "AB")
    assert (a.seal(), a.guaranteed, b.seal(), b.guaranteed) == ("not analysed", False, "clean", True)
    assert s.translate("A").guaranteed
    assert not Session(spark, {"A": "define view A as select x from no_such_table"}).translate("A", analyse=True).guaranteed


def test_exports(spark, tmp_path):
    rows = [("B", "b", "view", True, 3, 0, 0, 0, 0, ""), ("A", "a", "view", True, 5, 0, 0, 0, 0, ""), ("C", "c", "view", True, 1, 0, 0, 0, 2, "x | y"), ("D", "", "", False, 0, 0, 0, 0, 1, "z")]
    c = spark.createDataFrame(rows, certainty.FIELDS)
    export_certainty(c, str(tmp_path))
    lines = [x for p in sorted((tmp_path / "certeza.csv").glob("part*")) for x in p.read_text().splitlines()]
    assert lines[0].startswith("ddlname,entidade,tipo,gerou_sql") and [x[0] for x in lines if not x.startswith("ddlname")] == ["A", "B", "C", "D"]
    assert [x for p in sorted((tmp_path / "garantidas.txt").glob("part*")) for x in p.read_text().splitlines()] == ["A", "B"]
    assert [r.ddlname for r in certainty.by_fields(c).collect()] == ["B", "A"]
    assert certainty.summary(c).split() == "2 without advisories 1 with advisories 1 without SQL 4 in all".split()


def test_saved_metadata(spark, read_table, tmp_path):
    source = "@AbapCatalog.sqlViewName: 'ZV'\n@EndUserText.label: 'Ação'\ndefine view entity Z_E as select from customer as c association [0..*] to orders as _O on c.c_custkey = _O.o_custkey { key c.c_custkey as Id, _O.o_orderkey as Oid } union all select from supplier as s join nation as n on n.n_nationkey = s.s_nationkey { key s.s_suppkey as Id, s.s_suppkey as Oid }"
    s = Session(spark, {"/NS/V": source}, tables=read_table)
    r = s.translate("/NS/V", write_to=str(tmp_path))
    meta = json.loads((tmp_path / "NS_V" / "metadata.json").read_text(encoding="utf-8"))
    want = {
        "ddlname": "/NS/V", "entidade_cds": "Z_E", "sql_view_hana": "ZV", "label": "Ação", "tipo": "view entity", "estilo": "entity", "entidade_base": "customer", "n_campos": 2, "n_associacoes": 1, "n_joins": 1, "n_branches_union": 2,
        "truncado": False, "n_avisos": 1, "avisos": r.advisories, "tabelas_fisicas": ["CUSTOMER", "NATION", "SUPPLIER"], "cds_dependentes": ["/NS/V"], "dependencias_truncadas": [], "dependencias_nao_encontradas": [],
    }
    assert {k: v for k, v in meta.items() if k != "gerado_em_utc"} == want and meta["gerado_em_utc"].endswith("+00:00")
    assert "[0..*] may repeat rows" in r.advisories[0] and (tmp_path / "NS_V" / "avisos.txt").read_text() == f" 1. {r.advisories[0]}\n"
    assert saved(save(r, str(tmp_path), dry=True), dry=True).startswith("not written: ") and "metadata.json" in saved(save(r, str(tmp_path)))
    header = r.sql.splitlines()
    assert header[:4] == ["-- source: /NS/V", "-- label: Ação", "-- SQL view: ZV", "-- entity: Z_E (view entity)"] and "-- blocks: 2" in header and "  -- key" in r.sql
    df = s.read("/NS/V")
    assert [f.metadata for f in s.read("/NS/V").schema.fields] == [f.metadata for f in df.schema.fields] and frame(parse("Z", "define view Z as select from region as r { key r.r_regionkey as K, r.r_name }"), read_table).schema["K"].metadata == {"key": True}


def test_every_tree_tag():
    views = {
        "ROOT": "define view R as select from A as a join B as b on a.x = b.x association [0..1] to ASSOC as _A on a.x = _A.x { a.x }", "A": "define view A as select from COMMON as c { c.x }", "B": "define view B as select from COMMON as c join ROOT as r on c.x = r.x join CUT as k on k.x = c.x join LOST as l on l.x = c.x { c.x }",
        "COMMON": "define view C as select from t001 as t { t.x }", "CUT": "define view K as select from t { x", "KNOWN": "define view N as select from t { x }", "ASSOC": "define view S as select from KNOWN as k { k.x }",
    }
    parsed = {k: parse(k, v) for k, v in views.items()}
    lookup = lambda n: parsed.get(n.upper())
    options = {"is_view": lambda n: n.upper() in parsed or n == "LOST", "known_truncated": frozenset({"KNOWN"})}
    t = tree("ROOT", lookup, **options)
    assert [(r["level"], r["tipo"]) for r in t.rows] == [(0, "CDS"), (1, "CDS"), (2, "CDS"), (3, "TABELA"), (1, "CDS"), (2, "REPETIDO"), (2, "CICLO"), (2, "TRUNCADO"), (3, "AVISO"), (2, "ERRO")]
    assert (t.tables, t.truncated, t.missing, t.views) == ({"T001"}, {"CUT"}, {"LOST"}, {"ROOT", "A", "B", "COMMON", "CUT"})
    assert [r["tipo"] for r in tree("ROOT", lookup, associations=True, **options).rows][-3:] == ["CDS", "TRUNCADO", "AVISO"]
    # The order of the checks: number of nodes, cycle, table, repeated, depth, missing, truncated.
    assert [r["tipo"] for r in tree("ROOT", lookup, nodes=3, **options).rows] == ["CDS", "CDS", "CDS", "LIMITE_GLOBAL"]
    assert [r["tipo"] for r in tree("ROOT", lookup, depth=1, **options).rows] == ["CDS", "CDS", "LIMITE", "CDS", "LIMITE", "CICLO", "LIMITE", "LIMITE"]
    assert t.text().splitlines()[3] == "            └── t001"


@pytest.mark.parametrize("source", ["define view Z as select from a, b { a.x }", "define view Z as (select x from a) union (select x from b)", "define view Z as select x from a union ( select x from b )"])
def test_unsupported_isn_t_truncated(source):
    v = parse("Z", source)
    assert not v.truncated and not v.parsed and "translated" in v.advisories[-1]


def test_unsupported_kinds_with_words():
    for kind in ("root custom entity", "root abstract entity"):
        v = parse("Z", f"define {kind} Z {{ a : b; }}")
        assert not v.truncated and not v.parsed and v.advisories == [f"a {kind} has no select to translate"]


def test_limit_isn_t_run(read_table):
    with pytest.raises(ValueError, match="limit"):
        frame(parse("Z", "define view Z as select r_name as N from region limit 2"), read_table)


@pytest.mark.parametrize("text", ["$session.user", "tstmp_current_utctimestamp()", "tstmpl_from_utcl(x)", "currency_conversion(amount)", "unit_conversion(q)", "cast(x as abap.curr(5,2))", "cast(x as bukrs)", "dats_is_valid(x)"])
def test_reported(text):
    v = parse("Z", f"define view Z as select {text} as X from t")
    assert v.parsed and body(v, lambda n: n) and len(v.advisories) == 1 and v.advisories[0].endswith("check by hand")


def test_annotations():
    v = parse("Z", "@A.b: [ { x: 'a}' }, #Y ]\n@C: true\n@EndUserText.label: 'one'\n@<D.e: -1\ndefine view Z as select from t { @UI.x: [{ p: 10 }] key a, b @<Z.z: 'q', @M: #N.O c }")
    assert v.parsed and v.label == "one" and [(i.expr[0].text, i.key) for i in v.blocks[0].items] == [("a", True), ("b", False), ("c", False)] and not v.advisories


def test_parameter_values():
    assert [literal(x) for x in (None, True, 3, 1.5, Decimal("2.50"), date(2020, 1, 2), "it's \\ a")] == ["NULL", "TRUE", "3", "1.5D", "2.50BD", "DATE'2020-01-02'", "'it\\'s \\\\ a'"]
    with pytest.raises(TypeError):
        literal([1])


def test_classes_take_few_patterns(spark):
    m = spark.createDataFrame([("A", "define view A as select from t { x }")], "ddlname string, source string")
    plan = metrics.classified(metrics.metrics(m))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") + plan.count("regexp_extract(") <= 30
