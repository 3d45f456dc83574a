"""Lines that define a name, per language."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import search
from spindrift.plans.definitions import definition_line
from spindrift.plans.grammar import Settings, parse
from spindrift.sources.entries import enriched
from spindrift.sources.walk import ROWS

YES = {
    "go": ["func Area(x int) int {", "func (s *Shape) Area(x int) {", "type Area struct {", "\tvar Area = 3", "const Area int = 4"],
    "h": ["class Area : public Shape {", "class MY_EXPORT Area final {", "enum class Area : int {", "  struct Area { int a; };", "template <class T> "
        "class Area {", "typedef union Area {", "# define Area(x) (x)", "class Area { int a; };"],
    "cc": ["void Shape::Area(int x) {", "Shape::~Area() {", "a::b::Area ()", "static int Area(const char* s) {", "int*Area(int x) {", "int Area(int "
        "x) { return x; }", "std::map<int, int> Area(int x)", "char **Area (void) {"],
    "py": ["def Area(self):", "    async def Area():", "class Area(Shape):", "Area = 3", "Area: int = 3", "Area=3"],
    "ts": ["export class Area {", "export default abstract class Area {", "export const Area = () => 1;", "let Area: number", "export declare "
        "interface Area {", "function Area(a: number) {", "async function* Area() {", "function *Area() {", "  Area(a: number): void {", "  private "
        "static async Area<T>(a: T) {", "export default function Area() {"],
    "rs": ["pub fn Area() {}", "pub struct Area {", "macro_rules! Area {", "impl X { const Area: u8 = 1; }"],
    "java": ["public class Area extends Shape {", "  public static int Area(int x) {", "  List<String[]> Area (int x) { return y; }", "record "
        "Area(int a) {}"],
    "kt": ["fun Area(x: Int): Int {", "fun <T> List.Area() = 1", "object Area"],
    "lua": ["function Area()", "local function Area(x)", "class Area"],
}
NO = {
    "go": ["\tArea()", "// func Area() is old", "x := Area", "# func Area()", "func Areal() {"],
    "h": ["class Area;", "struct Area x;", "  friend class Area;", "* class Area {"],
    "cc": ["  int Area(int a);", "  if (Area(x)) {", "  return Area(x);", "  Area(x);", "  x = Area(y);", "void Shape::Area(int x);", "/* int Area() "
        "*/"],
    "py": ["Area()", "# def Area()", "Area == 3", "  Area = 3", "print(Area)", "return Area"],
    "ts": ["  Area(a);", "const x = new Area();", "if (Area(x)) {", "while (Area()) {"],
    "rs": ["let y = Area();", "fnArea"],
    "java": ["    return Area(x);", "    int y = Area(x);", "  abstract int Area(int x);"],
    "lua": ["call Area()", "x = Area"],
}


def test_lines_that_define_a_name(spark):
    rows = [(ext, line, want) for table, want in ((YES, True), (NO, False)) for ext, lines in table.items() for line in lines]
    got = spark.createDataFrame(rows, "ext_l string, line string, want boolean").withColumn("got", definition_line(F.col("line"), "Area")).collect()
    assert [(r["ext_l"], r["line"]) for r in got if r["got"] != r["want"]] == []


@pytest.mark.parametrize(
    "line", ["a" * 100_000, "a " * 50_000, "a*" * 50_000 + "Area", "<" * 100_000 + " Area", "Area(" * 20_000, "public " * 20_000 + "Area"]
)
def test_long_lines_end(spark, line):
    rows = spark.createDataFrame([(e, line) for e in ("cc", "ts", "java", "go", "x")], "ext_l string, line string")
    assert rows.where(definition_line(rows["line"], "Area")).count() <= 5


def test_definition_search(spark):
    texts = {
        "a.go": "package a\n\nfunc Foo() int {\n}\n", "b.go": "func g() {\n\tFoo()\n}\n", "c.h": "class Foo : public Base {\r\n  void Run();\n};\n",
        "d.h": "class Foo;\nvoid Use(Foo* f);\n", "e.cc": "void Foo::Run() {\n  if (Foo(x)) {\n", "f.py": "def Foo():\n", "g.py": "Foo()\n",
        "h.ts": "export class Foo {\n", "i.ts": "const x = new Foo();\n", "j.rs": "pub fn Foo() {}\n", "n.rs": None
    }
    files = enriched(spark.createDataFrame([("C:", i, f"C:\\{n}", 32, 1, 1, "t", t) for i, (n, t) in enumerate(texts.items())], ROWS))
    for q, want in {"sym:Foo": "a.go c.h f.py h.ts j.rs", "sym:Run": "e.cc", "sym:Foo ext:py": "f.py", "sym:Nope": ""}.items():
        assert sorted(r["name"] for r in search.matching(files, parse(q, Settings(now=1))).collect()) == want.split()
    ranked = [r["name"] for r in search.search(files, "content:Foo sort:relevance", Settings(now=1)).collect()]
    assert set(ranked[:5]) == {"a.go", "c.h", "f.py", "h.ts", "j.rs"} and len(ranked) == 10
