"""Queries over host files composed from customers, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.operators import hosts as H
from fleetgrade.operators import lines as LN
from fleetgrade.session import cut
from fleetgrade.workload.blocks import Blocks
from fleetgrade.workload.registry import query, table



def _nodes(files: DataFrame) -> DataFrame:
    return cut(H.yaml_nodes(files))


SHA = "0123456789abcdef0123456789abcdef01234567"

DOCKER = Blocks("customer", "c_custkey", "d/", "/Dockerfile", (
    (("FROM ubuntu", (("DKR001", 0, "ubuntu", None),)), ("FROM alpine:3.19 AS base", ()), ("# syntax=x\nFROM --platform=linux/amd64 repo.example.org:5000/img", (("DKR001", 1, "repo.example.org:5000/img", None),)),
     ("FROM x@sha256:aa", ())),
    (("RUN apt-get update && \\\n    # note\n    apt-get install -y curl", (("DKR006", 0, "apt-get install", None), ("DKR007", 0, "apt", None))),
     ("RUN apt-get install --no-install-recommends -y a && rm -rf /var/lib/apt/lists/*", ()), ("RUN apk add curl", (("DKR007", 0, "apk", None),)), ("RUN --mount=type=cache,target=/x apk add curl", ()),
     ("RUN dnf -y install a && dnf clean all", ()), ("RUN yum install -y a", (("DKR007", 0, "dnf / yum", None),)), ("RUN [\"apt\", \"x\"]", ())),
    (("ADD https://x.example.org/a.tgz /a", (("DKR003", 0, "https://x.example.org/a.tgz", None),)), ("ADD --checksum=sha256:1 https://x.example.org/a /a", ()), ("ADD app.py b.tar.gz /srv/", (("DKR004", 0, "app.py", None),)),
     ("COPY . /srv", ())),
    (("ENV DB_PASSWORD=abc", (("DKR005", 0, "DB_PASSWORD", None),)), ("ENV TOKEN my value", (("DKR005", 0, "TOKEN", None),)), ("ARG API_KEY", (("DKR005", 0, "API_KEY", "medium"),)),
     ("ENV A=1 SECRET_FILE=/x PASSWORD=$P", ()), ("ARG SECRET=xyz", (("DKR005", 0, "SECRET", None),)), ("RUN <<EOF\nADD not-an-instruction /x\nEOF", ())),
    (("USER app", ()), ("USER root", ()), ("WORKDIR /srv", ()), ("SHELL [\"/bin/bash\", \"-o\", \"pipefail\", \"-c\"]", ()), ("FROM base", ()), ("FROM scratch", ()), ("FROM img-nonroot:1\nUSER 0:0", ())),
), ("rule", "off", "extra", "sev"))

_USER_SQL = """ending AS (SELECT path, k, (SELECT start FROM doc_pos q WHERE q.path = p.path AND q.slot = 4) AS s4,
  p.ix AS last, (SELECT ix FROM doc_pos q WHERE q.path = p.path AND q.slot = 0) AS head, (SELECT start FROM doc_pos q WHERE q.path = p.path AND q.slot = 0) AS s0 FROM doc_pos p WHERE slot = 4),
root AS (SELECT path, 'DKR002' AS rule, CASE last WHEN 1 THEN s4 WHEN 2 THEN s0 + CASE WHEN head = 2 THEN 1 ELSE 0 END WHEN 3 THEN s0 + CASE WHEN head = 2 THEN 1 ELSE 0 END WHEN 4 THEN s4 END AS line,
  CASE last WHEN 1 THEN 'USER root' WHEN 4 THEN 'base' ELSE (['ubuntu', 'alpine:3.19', 'repo.example.org:5000/img', 'x@sha256:aa'])[head + 1] END AS extra FROM ending WHERE last IN (1, 2, 3, 4)),
again AS (SELECT path, 'DKR001' AS rule, s4 AS line, 'base' AS extra FROM ending WHERE last = 4 AND head <> 1)"""


@query("docker_rules", f"""WITH {DOCKER.ctes('doc')}, {_USER_SQL} SELECT path, rule, line, extra, sev FROM doc
 UNION ALL SELECT path, rule, line, extra, NULL FROM root UNION ALL SELECT path, rule, line, extra, NULL FROM again""")
def docker_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = H.docker_rules(H.docker_instructions(DOCKER.files(spark, sf)))
    return out.withColumnRenamed("own_severity", "sev")


@query("docker_instructions", f"""WITH {DOCKER.ctes('doc')}, n(slot, ix, instr, off) AS (VALUES (0,0,'FROM',0),(0,1,'FROM',0),(0,2,'FROM',1),(0,3,'FROM',0),
 {','.join(f"(1,{i},'RUN',0)" for i in range(7))},(2,0,'ADD',0),(2,1,'ADD',0),(2,2,'ADD',0),(2,3,'COPY',0),(3,0,'ENV',0),(3,1,'ENV',0),(3,2,'ARG',0),(3,3,'ENV',0),(3,4,'ARG',0),(3,5,'RUN',0),
 (4,0,'USER',0),(4,1,'USER',0),(4,2,'WORKDIR',0),(4,3,'SHELL',0),(4,4,'FROM',0),(4,5,'FROM',0),(4,6,'FROM',0),(4,6,'USER',1))
 SELECT path, CAST(start + off AS INTEGER) AS line, instr, CAST(CASE WHEN slot = 1 AND ix = 0 THEN start + 2 WHEN slot = 3 AND ix = 5 THEN start + 2 ELSE start + off END AS INTEGER) AS end_line FROM doc_pos JOIN n USING (slot, ix)""")
def docker_instructions(spark: SparkSession, sf: str) -> DataFrame:
    return H.docker_instructions(DOCKER.files(spark, sf)).select("path", "line", "instr", "end_line")


FLOW = Blocks("customer", "c_custkey", "w/", "/.github/workflows/ci.yml", (
    (("on: push", ()), ("on: [push, pull_request_target]", ()), ("on:\n  workflow_run:\n    workflows: [a]", ())),
    (("permissions: read-all", ()), ("name: no permissions", ()), ("permissions: write-all", (("CI002", 0, "write-all", "high"),)),),
    (("env:\n  API_TOKEN: abc123", (("CI004", 1, "API_TOKEN", None),)), ("env:\n  API_TOKEN: ${{ secrets.T }}", ()), ("defaults:\n  run:\n    shell: pwsh", ())),
    (("jobs:\n  build:\n    runs-on: ubuntu-latest\n    container: node\n    steps:", (("CI005", 3, "node", None),)), ("jobs:\n  build:\n    runs-on: ubuntu-latest\n    permissions:\n      contents: read\n    container:\n      image: node:20\n    steps:", ())),
    (("      - uses: actions/checkout@v4\n        with:\n          ref: main", (("CI001", 0, "actions/checkout@v4", "low"),)), (f"      - uses: some/action@{SHA}", ()), ("      - uses: other/tool@v1", (("CI001", 0, "other/tool@v1", None),)),
     ("      - uses: docker://alpine", (("CI005", 0, "alpine", None),)), (f"      - uses: actions/checkout@{SHA}\n        with:\n          ref: ${{{{ github.event.pull_request.head.sha }}}}", ())),
    (("      - shell: bash\n        run: echo \"${{ github.event.issue.title }}\"", (("SEC023", 1, "${{ github.event.issue.title }}", None),)),
     ("      - shell: bash\n        run: |\n          echo a\n          echo ${{ github.head_ref }} ${{ matrix.x }}", (("SEC023", 3, "${{ github.head_ref }}", None),)), ("      - name: quiet\n        shell: python\n        run: print('${{ github.head_ref }}')", ())),
), ("rule", "off", "extra", "sev"))


@query("workflow_rules", f"""WITH {FLOW.ctes('fl')}, spots AS (SELECT path, max(CASE WHEN slot = 0 THEN ix END) AS trig, max(CASE WHEN slot = 1 THEN ix END) AS perm, max(CASE WHEN slot = 3 THEN ix END) AS job,
 max(CASE WHEN slot = 3 THEN start END) AS js, max(CASE WHEN slot = 4 THEN ix END) AS step, max(CASE WHEN slot = 4 THEN start END) AS ss FROM fl_pos GROUP BY path)
 SELECT path, rule, line, extra, sev FROM fl UNION ALL SELECT path, 'CI002', CAST(js + 1 AS INTEGER), 'build', NULL FROM spots WHERE perm = 1 AND job = 0
 UNION ALL SELECT path, 'CI003', CAST(ss + 2 AS INTEGER), '${{{{ github.event.pull_request.head.sha }}}}', NULL FROM spots WHERE trig IN (1, 2) AND step = 4""")
def workflow_rules(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(FLOW.files(spark, sf))
    out = H.workflow_rules(nodes).unionByName(H.untrusted_expressions(nodes))
    return out.withColumnRenamed("own_severity", "sev")


@query("workflow_run_blocks", f"""WITH {FLOW.ctes('fl')}, r(ix, off, text) AS (VALUES (0, 1, 'echo "' || repeat('x', 31) || '"'), (1, 2, 'echo a'), (1, 3, 'echo ' || repeat('x', 22) || ' ' || repeat('x', 15)))
 SELECT path, CAST(start + off AS INTEGER) AS line, text, 'bash' AS shell FROM fl_pos JOIN r USING (ix) WHERE slot = 5""")
def workflow_run_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = H.workflow_run_blocks(_nodes(FLOW.files(spark, sf)))
    return rows.select("path", "line", H.mask_expressions(F.col("text"), H.EXPRESSION).alias("text"), "shell")


@query("yaml_nodes", f"WITH {FLOW.ctes('fl')} SELECT path, CASE ix WHEN 0 THEN 'push' END AS value, start AS line FROM fl_pos WHERE slot = 0 AND ix = 0")
def yaml_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(FLOW.files(spark, sf))
    return nodes.filter((F.size("keys") == 1) & (F.element_at("keys", 1) == "on") & (F.col("kind") == "scalar")).select("path", "value", "line")


LAB = Blocks("customer", "c_custkey", "g/", "/.gitlab-ci.yml", (
    (("image: ruby", (("CI005", 0, "ruby", None),)), ("image:\n  name: ruby:3", ()), ("variables:\n  DB_PASSWORD: hunter2", (("CI004", 1, "DB_PASSWORD", None),)), ("variables:\n  DB_PASSWORD:\n    value: abc", (("CI004", 2, "DB_PASSWORD", None),))),
    (("before_script:\n  - echo top", (("code", 1, "echo top", "bash"),)), ("stages: [a, b]", ()), ("default:\n  before_script: echo dflt", (("code", 1, "echo dflt", "bash"),))),
    (("job:\n  services:\n    - redis\n    - name: pg:16\n  script:\n    - echo a\n    - |\n      line one\n      line two\n    - [nested, list]", (("CI005", 2, "redis", None), ("code", 5, "echo a", "bash"), ("code", 7, "line one", "bash"), ("code", 8, "line two", "bash"))),
     ("job:\n  variables:\n    API_TOKEN: $X\n    KEY_PATH: a\n  after_script:\n    - echo z", (("code", 5, "echo z", "bash"),))),
), ("rule", "off", "extra", "sev"))


@query("gitlab_rules", f"WITH {LAB.ctes('gl')} SELECT path, rule, line, extra FROM gl WHERE rule <> 'code'")
def gitlab_rules(spark: SparkSession, sf: str) -> DataFrame:
    return H.gitlab_rules(_nodes(LAB.files(spark, sf))).select("path", "rule", "line", "extra")


@query("gitlab_blocks", f"WITH {LAB.ctes('gl')} SELECT path, line, extra AS text FROM gl WHERE rule = 'code'")
def gitlab_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return H.gitlab_blocks(_nodes(LAB.files(spark, sf))).select("path", "line", "text")


PLAY = Blocks("customer", "c_custkey", "a/", "/play.yml", (
    (("- hosts: all\n  tasks:", ()), ("# head\n- hosts: db\n  tasks:", ())),
    (("    - name: one\n      shell: ls {{ dir }}", (("code", 1, "ls xxxxxxxxx", "sh"),)), ("    - ansible.builtin.shell: |\n        a\n        b\n      args:\n        executable: /bin/bash", (("code", 1, "a", "bash"), ("code", 2, "b", "bash"))),
     ("    - shell:\n        cmd: run it\n        executable: /bin/bash", (("code", 1, "run it", "bash"),)), ("    - command: not shell", ()), ("    - shell: now=`date`", (("code", 0, "now=`date`", "sh"),))),
    (("    - block:\n        - ansible.legacy.shell: deep", (("code", 1, "deep", "sh"),)), ("    - debug: msg=x", ())),
), ("rule", "off", "extra", "sev"))


@query("ansible_blocks", f"WITH {PLAY.ctes('pl')} SELECT path, line, extra AS text, sev AS shell FROM pl")
def ansible_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = H.ansible_blocks(_nodes(PLAY.files(spark, sf)))
    return rows.select("path", "line", H.mask_expressions(F.col("text"), H.TEMPLATE).alias("text"), "shell")


MAKE = Blocks("customer", "c_custkey", "m/", "/Makefile", (
    (("SHELL := /bin/bash", ()), ("X = 1", ()), ("ifeq ($(A),b)\nendif", ())),
    (("all: a b", ()), ("define T\n\tnot code\nendef\nall:", ()), ("%.o: %.c", ())),
    (("\t@echo $(CC) $$HOME $@", (("code", 0, "  echo xxxxx $HOME xx", None),)), ("\t-rm -rf $(OUT)/x", (("code", 0, "  rm -rf xxxxxx/x", None), ("SEC007", 0, "$(OUT)", None))), ("\tcd a && \\\n\t  ls $(shell echo $(Y))", (("code", 0, " cd a && \\", None), ("code", 1, "   ls xxxxxxxxxxxxxxxxxx", None)))),
    (("VAR = a", ()), ("# note", ()), ("clean: ; rm x", ())),
    (("\tlast ${A}", ()), ("other:\n\techo done", (("code", 1, " echo done", None),))),
), ("rule", "off", "extra", "sev"))


@query("make_recipes", f"""WITH {MAKE.ctes('mk')}, spots AS (SELECT path, max(CASE WHEN slot = 3 THEN ix END) AS b3, max(CASE WHEN slot = 4 THEN ix END) AS b4, max(CASE WHEN slot = 4 THEN start END) AS s4 FROM mk_pos GROUP BY path)
 SELECT path, line, extra AS text FROM mk WHERE rule = 'code' UNION ALL SELECT path, CAST(s4 AS INTEGER), ' last xxxx' FROM spots WHERE b3 IN (1, 2) AND b4 = 0""")
def make_recipes(spark: SparkSession, sf: str) -> DataFrame:
    return H.make_recipes(MAKE.files(spark, sf)).select("path", "line", "text")


@query("make_rules", f"WITH {MAKE.ctes('mk')} SELECT path, rule, line, extra FROM mk WHERE rule = 'SEC007'")
def make_rules(spark: SparkSession, sf: str) -> DataFrame:
    return H.make_rules(H.make_recipes(MAKE.files(spark, sf))).select("path", "rule", "line", "extra")


@query("mask_expressions", """SELECT page_id, length(html) AS before, CAST(len(regexp_extract_all(html, '<a [^>]*>')) AS INTEGER) AS hits,
 md5(list_reduce(list_prepend(html, list_distinct(regexp_extract_all(html, '<a [^>]*>'))), lambda t, m: replace(t, m, repeat('x', length(m))))) AS digest FROM pages""")
def mask_expressions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", F.length("html").alias("before"), F.size(F.regexp_extract_all("html", F.lit("(<a [^>]*>)"), F.lit(1))).alias("hits"),
                    F.md5(F.encode(H.mask_expressions(F.col("html"), "<a [^>]*>"), "UTF-8")).alias("digest"))


def all_hosts(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for b in (DOCKER, FLOW, LAB, PLAY, MAKE):
        part = b.files(spark, sf)
        out = part if out is None else out.unionByName(part)
    return LN.with_model(out)


@query("host_shell_lines", f"""WITH {LAB.ctes('gl')}, {PLAY.ctes('pl')} SELECT path, line, extra AS raw FROM gl WHERE rule = 'code' UNION ALL SELECT path, line, extra FROM pl""")
def host_shell_lines(spark: SparkSession, sf: str) -> DataFrame:
    return H.shell_lines(all_hosts(spark, sf)).filter("path like 'g/%' or path like 'a/%'").select("path", "line", "raw")


_FLOW_SPOTS = """fspots AS (SELECT path, max(CASE WHEN slot = 0 THEN ix END) AS trig, max(CASE WHEN slot = 1 THEN ix END) AS perm, max(CASE WHEN slot = 3 THEN ix END) AS job,
 max(CASE WHEN slot = 3 THEN start END) AS js, max(CASE WHEN slot = 4 THEN ix END) AS step, max(CASE WHEN slot = 4 THEN start END) AS ss FROM fl_pos GROUP BY path)"""


@query("host_rules", f"""WITH {LAB.ctes('gl')}, {MAKE.ctes('mk')}, {DOCKER.ctes('doc')}, {_USER_SQL}, {FLOW.ctes('fl')}, {_FLOW_SPOTS}
 SELECT path, rule, line FROM gl WHERE rule <> 'code' UNION ALL SELECT path, rule, line FROM mk WHERE rule = 'SEC007'
 UNION ALL SELECT path, rule, line FROM doc UNION ALL SELECT path, rule, line FROM root UNION ALL SELECT path, rule, line FROM again
 UNION ALL SELECT path, rule, line FROM fl UNION ALL SELECT path, 'CI002', CAST(js + 1 AS INTEGER) FROM fspots WHERE perm = 1 AND job = 0
 UNION ALL SELECT path, 'CI003', CAST(ss + 2 AS INTEGER) FROM fspots WHERE trig IN (1, 2) AND step = 4""")
def host_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of all five kinds of host files at once."""
    return H.host_rules(all_hosts(spark, sf)).select("path", "rule", "line")


@query("virtual_scripts", f"""WITH {PLAY.ctes('pl')} SELECT path, max(line) AS n, string_agg(extra, '|' ORDER BY line) AS text, CASE WHEN bool_or(sev = 'bash') THEN 'bash' ELSE 'sh' END AS dialect FROM pl GROUP BY path""")
def virtual_scripts(spark: SparkSession, sf: str) -> DataFrame:
    v = H.virtual_scripts(LN.with_model(PLAY.files(spark, sf)))
    lines = LN.to_lines(v, "dialect").filter("raw <> ''")
    return lines.groupBy("path", "dialect").agg(F.max("line").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda s: s["raw"]), "|").alias("text"))


@query("host_directive_lines", f"""WITH {PLAY.ctes('pl')} SELECT path, line, extra AS raw FROM pl UNION ALL SELECT path, start, '# head' FROM pl_pos WHERE slot = 0 AND ix = 1""")
def host_directive_lines(spark: SparkSession, sf: str) -> DataFrame:
    files = LN.with_model(PLAY.files(spark, sf))
    return H.host_directive_lines(H.shell_lines(files), LN.to_lines(files)).filter("raw <> ''")


@query("host_shell_findings")
def host_shell_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Shell rules over the shell of all host files, meaningless ones dropped."""
    from fleetgrade.operators import shell_rules as SR

    virtual = cut(H.virtual_scripts(all_hosts(spark, sf)).withColumn("has_crlf", F.lit(False)))
    found = SR.shell_findings(LN.mask_lines(virtual), virtual)
    return LN.drop_embedded_rules(found, virtual.select("path", "pipefail")).groupBy("rule").agg(F.count("*").alias("n"))
