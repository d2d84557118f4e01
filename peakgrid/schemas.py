"""Schemas of the domain tables (positions are base pairs, ``v`` is value x 10000)."""
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

S, I, L, D = StringType(), IntegerType(), LongType(), DoubleType()


def _table(**fields: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


SPAN = _table(chrom=S, start=I, end=I)
EXONS = ArrayType(_table(start=I, end=I))

GENOME = _table(chrom=S, length=I, mappable=L, ord=I)
READS = _table(sample=S, read_id=L, chrom=S, strand=S, f3=I, f5=I, len_f3=I, len_f5=I, nh=I, mate_chrom=S,
               tlen=I, weight=D)
BINS = _table(sample=S, chrom=S, bin=I, v=L)
INTERVALS = _table(chrom=S, start=I, end=I, summit=I, name=S)
PEAKS = _table(sample=S, chrom=S, start=I, end=I, length=I, summit=I, pileup=D, pileup_input=D, enrichment=D,
               p_internal=D, p_enrich=D, peak_no=L)
GENES = _table(chrom=S, tid=S, gid=S, tname=S, gname=S, strand=S, tx_start=I, tx_end=I, cds_start=I, cds_end=I,
               exon=EXONS, gtype=S, ttype=S, tag=S)
INTERACTIONS = _table(set_label=S, first=SPAN, second=SPAN, val=D)
BARCODES = _table(barcode=S, chrom=S, pos=I)
SAMPLES = _table(chip=S, input=S, label=S, peak_list=S, binsize=I, scale_tag=D, scale_ratio=D, scale_pvalue=D,
                 overlay_of=S)
