"""Explicit schemas of the domain tables."""

from pyspark.sql import types as T


def _table(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()

COUNTS = _table(project=_S, sample_id=_S, taxon_id=_S, n=_L)
PROFILE = _table(sample_id=_S, taxon_id=_S, rel_abund=_D)
SEQUENCES = _table(taxon_id=_S, seq=_S)
ALIGNMENT = _table(taxon_id=_S, aln=_S)
DISTANCES = _table(a=_S, b=_S, d=_D)
NEIGHBOURS = _table(query=_S, answer=_S, similarity=_D)
SAMPLE_METADATA = _table(
    srs=_S, project=_S, library_strategy=_S, library_source=_S, total_bases=_L,
    instrument=_S, geo_loc_name=_S, iso=_S, region=_S,
)
PROJECT_METADATA = _table(project=_S, condition=_S, subjects=_S, amplicon=_S, avg_length=_D)
ALIGN_REPORT = _table(
    QueryName=_S, QueryLength=_I, QueryStart=_I, QueryEnd=_I, TemplateStart=_I, TemplateEnd=_I,
)
TREE = _table(node_id=_L, parent_id=_L, name=_S, branch_length=_D)
RESULTS = _table(
    SampleId=_S, KL_err=_D, RMSL_err=_D, SpearmanCorr=_D, BrayCurtis=_D,
    RootJensenShannon=_D, NumTaxa=_L, NumASV=_L, NumSGB=_L, NumParameters=_L,
)
MARKER_VECTORS = T.StructType([
    T.StructField("marker_id", _S),
    T.StructField("shard", _I),
    T.StructField("vec", T.ArrayType(T.FloatType())),
])
