"""Cataloguing blocks and file names on golden values."""

from pyspark.sql import functions as F

from shelfspark.functions import blocks

#: Fixed value: a printed block with the values that must be read from it.
LOY = """Library of Congress Cataloging-in-Publication Data
Loy, David R., 1947–
A Buddhist history of the West : studies in lack / David R. Loy.
p. cm. — (SUNY series in religious studies)
Includes bibliographical references and index.
ISBN 0-7914-5259-X (alk. paper) — (ISBN 0-7914-5260-3 (pbk. : alk. paper)
1. Civilization, Western—Psychological aspects. 2. Civilization, Western—Philosophy.
3. Civilization, Western—Classical influences. 4. Philosophy, Buddhist. 5.
Buddhism—Doctrines. 6. Self (Philosophy) 7. Identity (Psychology) 8.
Self-consciousness. I. Title. II. Series.
CB245.R68 2002
909'.09821—dc21 2001049415"""


def test_whole_block():
    r = blocks.parse_cip(LOY)
    assert (r["source"], r["author"], r["author_dates"]) == ("cip-lc", "Loy, David R.", "1947–")
    assert (r["title"], r["subtitle"], r["series"]) == ("A Buddhist history of the West", "studies in lack", "SUNY series in religious studies")
    assert r["isbns"] == [{"isbn": "079145259X", "label": "alk. paper"}, {"isbn": "0791452603", "label": "pbk. : alk. paper"}]
    assert (r["lc"], r["dewey"], r["lccn"], r["year"]) == ("CB245.R68", "909.09821", "2001049415", 2002)
    assert len(r["subjects"]) == 8 and r["subjects"][0] == "Civilization, Western—Psychological aspects"


def test_no_block_and_variants():
    assert blocks.parse_cip("Un libro cualquiera sin créditos.") is None and blocks.parse_cip("") is None and blocks.parse_cip(None) is None
    head = "Library of Congress Cataloging-in-Publication Data\n"
    assert blocks.parse_cip(head + "QA76.73 2010\n005.133 dc22 2009123456")["dewey"] == "005.133"
    assert blocks.parse_cip(head + "822.33 ddc23")["dewey"] == "822.33"


def test_file_names():
    f = blocks.parse_file_name
    assert f("9780306406157.pdf")["isbn"] == "9780306406157" and f(None) is None and f(" ") is None
    assert (f("Asimov [Fundacion 2] Imperio.epub")["series"], f("Asimov [Fundacion 2] Imperio.epub")["number"]) == ("Fundacion", "2")
    assert (f("Quo 2015-10.pdf")["title"], f("Quo 2015-10.pdf")["year"], f("Quo 2015-10.pdf")["month"]) == ("Quo", 2015, 10)
    assert (f("Quo octubre 2015.pdf")["title"], f("Quo octubre 2015.pdf")["month"]) == ("Quo", 10)
    assert (f("Titulo - Autor.pdf")["title"], f("Titulo - Autor.pdf")["author"]) == ("Titulo", "Autor")


def test_bracketed_heads():
    f = blocks.parse_file_name
    r = f("[Fundación 2] Asimov, Isaac - Fundación e Imperio [1234] (r1.2).epub")
    assert (r["series"], r["number"], r["author"], r["title"]) == ("Fundación", "2", "Asimov, Isaac", "Fundación e Imperio")
    r = f("[Crítica] Uno, Ana & Dos, Luis - Título - con guion (r2.0).epub")
    assert (r["publisher"], r["author"], r["title"]) == ("Crítica", "Uno, Ana & Dos, Luis", "Título - con guion")
    assert f("[solo].pdf")["title"] == "[solo]" and f("[2023] Obra.pdf")["title"] == "Obra"


def test_as_columns(spark):
    rows = spark.createDataFrame([(LOY,), (None,), ("x",)], "t string").select(blocks.cip_udf(F.col("t")).alias("c"), blocks.file_name_udf(F.lit("Quo 2015-10.pdf")).alias("f"))
    got = rows.collect()
    assert [r.c.title for r in got] == ["A Buddhist history of the West", None, None] and got[0].f.year == 2015
