"""Readers of other systems' files, on small hand-written ones."""

import pytest

from bomloom.sources import files

CYPHER = """// parts
CREATE (p1:Part {id:"100-001", desc:"MS Bolt, M10x70", cost: 5.30})
  CREATE (p2:Part {number:'100 002', unit:"EA"})
CREATE (a1:Asset {name:'an assembly'})
CREATE (a1)<-[:BELONGS_TO {qty:3.0, unit:"EA"}]-(p1)
CREATE (a1)<-[:BELONGS_TO]-(p2)
CREATE (a1)-[:BELONGS_TO {unit:'x', qty: 2}]->(f1)
MATCH (n) RETURN n
CREATE (f1)<-[:BELONGS_TO {qty: some}]-(q9)
"""
CYCLONEDX = """{"bomFormat": "CycloneDX", "metadata": {"component": {"bom-ref": "board", "name": "A board"}},
 "components": [{"bom-ref": "r1", "properties": [{"name": "cdx:device:location", "value": "U1"}, {"name": "cdx:device:quantity", "value": "4"}]},
  {"name": "only a name"}, {"bom-ref": "r3", "properties": [{"name": "cdx:device:quantity", "value": "many"}]}, {"type": "device"}]}"""
BILLS = """[{"doctype": "Item", "item_code": "x"}, {"doctype": "BOM", "item": "Chair", "items": [{"item_code": "Leg", "qty": 4, "rate": 2.5}, {"item_code": "Seat"}, {"qty": 1}]},
 {"doctype": "BOM", "items": [{"item_code": "lost"}]}, {"doctype": "BOM", "item": "none"}]"""
XML = """<?xml version="1.0"?><odoo><data noupdate="1">
<record id="bom_1" model="mrp.bom"><field name="product_tmpl_id" ref="product.desk_tmpl"/><field name="type">normal</field></record>
<record id="l1" model="mrp.bom.line"><field name="product_id" ref="product.panel"/><field name="product_qty">2</field><field name="bom_id" ref="mrp.bom_1"/></record>
<record id="l2" model="mrp.bom.line"><field name="product_id" ref="bolt"/><field name="product_qty" eval="4.5"/><field name="bom_id" ref="bom_1"/></record>
<record id="l3" model="mrp.bom.line"><field name="product_id" ref="nut"/><field name="bom_id" ref="bom_1"/></record>
<record id="l4" model="mrp.bom.line"><field name="product_id" ref="nut"/><field name="bom_id" ref="unknown"/></record>
<record id="p" model="product.product"><field name="name">Panel</field></record>
</data></odoo>"""
CSV = "Number,ChildNumber,Note,Qty\nA, B ,\"x, y\",2\nA,C,,\nA,D,,few\n,E,,1\nF,,,1\n"
OTHER = "Parent Part Number,Component,Quantity\nA,B,1.5\n"
CASES = {
    "cypher": (files.read_cypher, CYPHER, {("a1", "100-001", 3.0), ("a1", "100 002", 1.0), ("f1", "a1", 2.0), ("f1", "q9", 1.0)}),
    "cyclonedx": (files.read_cyclonedx, CYCLONEDX, {("board", "r1", 4.0), ("board", "only a name", 1.0), ("board", "r3", 1.0)}),
    "bills": (files.read_item_bills, BILLS, {("Chair", "Leg", 4.0), ("Chair", "Seat", 1.0)}),
    "xml": (files.read_record_xml, XML, {("desk_tmpl", "panel", 2.0), ("desk_tmpl", "bolt", 4.5), ("desk_tmpl", "nut", 1.0)}),
    "csv": (files.read_export_csv, CSV, {("A", "B", 2.0), ("A", "C", 1.0), ("A", "D", 1.0)}),
    "names": (files.read_export_csv, OTHER, {("A", "B", 1.5)}),
    "no names": (files.read_export_csv, "one,two\n1,2\n", set()),
    "no bills": (files.read_item_bills, "[]", set()),
}


@pytest.mark.parametrize("case", CASES)
def test_reader(spark, tmp_path, case):
    read, text, want = CASES[case]
    (tmp_path / "one.txt").write_text(text)
    got = [tuple(r) for r in read(spark, f"file://{tmp_path}").collect()]
    assert set(got) == want and len(got) == len(want)


def test_variables_hold_within_a_file(spark, tmp_path):
    for name in "xy":
        (tmp_path / f"{name}.cypher").write_text(f"CREATE (a:Part {{id:'{name}1'}})\nCREATE (b)<-[:HAS]-(a)\n")
    assert {tuple(r) for r in files.read_cypher(spark, f"file://{tmp_path}").collect()} == {("b", "x1", 1.0), ("b", "y1", 1.0)}
