"""Source files of nine languages made from the driver's tables, and what the extractor is to find in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: By language: the file's path and text; ``{k}`` is a part's key.
TEMPLATES = {
    "python": ("app/py{k}.py", '''import os
class C{k}:
    def m{k}(self, x):
        os.system(x)
        return self.h{k}(x)

@app.route("/r{k}")
def f{k}():
    return C{k}().m{k}("a")
'''),
    "javascript": ("web/js{k}.js", '''function f{k}(x) {
  return db.query(x);
}
const g{k} = (y) => {
  f{k}(y);
};
app.get("/r{k}", function (req, res) {
  g{k}(req);
});
'''),
    "typescript": ("web/ts{k}.ts", '''class C{k} {
  m{k}(x: string): void {
    eval(x);
  }
}
function f{k}(y: string) {
  helper{k}(y);
}
'''),
    "tsx": ("web/view{k}.tsx", '''function View{k}(props) {
  load{k}(props);
  return null;
}
'''),
    "java": ("src/J{k}.java", '''class J{k} {
  void m{k}(String x) {
    Runtime.getRuntime().exec(x);
    h{k}(x);
  }
}
'''),
    "go": ("cmd/go{k}.go", '''package main
func f{k}(x string) {
  exec.Command(x)
}
func main() {
  f{k}("a")
  http.HandleFunc("/r{k}", f{k})
}
'''),
    "php": ("www/p{k}.php", '''<?php
function f{k}($x) {
  system($_GET["a"]);
}
f{k}(1);
'''),
    "ruby": ("lib/r{k}.rb", '''class R{k}
  def m{k}(x)
    system(x)
  end
end
def f{k}(y)
  eval(y)
end
'''),
    "c_sharp": ("src/S{k}.cs", '''class S{k} {
  void M{k}(string x) {
    Process.Start(x);
  }
}
'''),
}
LANGUAGES = tuple(TEMPLATES)


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, lang, text): a file for each part, its language by the key."""
    key = F.col("p_partkey").cast("string")
    which = (F.col("p_partkey") % len(LANGUAGES)).cast("int")
    table = F.array(*[F.struct(F.lit(n).alias("lang"), F.lit(p).alias("path"), F.lit(t).alias("text")) for n, (p, t) in TEMPLATES.items()])
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("k"), table[which].alias("t"))
    return parts.select(F.lit("parts").alias("repo"), F.replace("t.path", F.lit("{k}"), F.col("k")).alias("path"), "t.lang", F.replace("t.text", F.lit("{k}"), F.col("k")).alias("text"))
