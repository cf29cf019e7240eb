from pyspark.sql import functions as F

from lectern.functions.stem import stems
from lectern.functions.text import terms
from lectern.operators.text_index import TextIndex

#: Words and stems of the sample that the rules are published with, its exceptions, and an example of each rule.
SAMPLE = """consign consigned:consign consigning:consign consignment:consign consist consisted:consist consistency:consist consistent:consist consistently:consist consisting:consist consists:consist
consolation:consol consolations:consol consolatory:consolatori console:consol consoled:consol consoles:consol consolidate:consolid consolidated:consolid consolidating:consolid consoling:consol consolingly:consol
consols:consol consonant:conson consort consorted:consort consorting:consort conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci conspirator:conspir conspirators:conspir conspire:conspir conspired:conspir
conspiring:conspir constable:constabl constables:constabl constance:constanc constancy:constanc constant knack knackeries:knackeri knacks:knack knag knave knaves:knave knavish kneaded:knead kneading:knead knee kneel
kneeled:kneel kneeling:kneel kneels:kneel knees:knee knell knelt knew knick knif knife knight knightly:knight knights:knight knit knits:knit knitted:knit knitting:knit knives:knive knob knobs:knob knock knocked:knock
knocker knockers:knocker knocking:knock knocks:knock knopp knot knots:knot
skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed
generate:generat generates:generat generating:generat general generally:general generic generically:generic generous generously:generous communism communication:communic
ties:tie cries:cri gas this gaps:gap kiwis:kiwi luxuriated:luxuri hopped:hop hoped:hope hoping:hope agreed:agre feed fizzed:fizz cry:cri by say enjoyed:enjoy national:nation relational:relat
analogy:analog happily:happili hopefulness:hope sensibility:sensibl adoption:adopt opinion rate:rate control controlled:control a is x2y 2nd été"""


def test_words_of_the_published_sample(spark):
    pairs = [(w.partition(":")[0], w.partition(":")[2] or w) for w in SAMPLE.split()]
    got = spark.createDataFrame([([w for w, _ in pairs],)], "ws array<string>").select(stems(F.col("ws")).alias("s")).first().s
    assert [(w, g, s) for (w, s), g in zip(pairs, got, strict=True) if g != s] == []


def test_both_sides_of_an_index(spark, tmp_path):
    analyse = lambda text: stems(terms(text))
    index = TextIndex(spark, str(tmp_path / "t"), analyse, buckets=2)
    index.add(spark.createDataFrame([(1, 1, "Consisting of KNIGHTS"), (2, 1, "consistent knots"), (3, 1, "none")], "chunk_id long, document_id long, content string"))
    found = index.search(spark.createDataFrame([(0, "the knight consists")], "qid int, text string")).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == [1, 2]
