"""Interval analytics on Spark: verbs over (chrom, start, end) tables as DataFrame plans."""

from .functions import concat, first, last, values, values_unique
from .operators.features import bed12_to_exons, create_introns, create_tss, create_utrs3, create_utrs5
from .operators.glyph import bed_glyph
from .operators.islands import bed_cluster, bed_complement, bed_genomecov, bed_merge, bed_partition
from .operators.joins import bed_closest, bed_coverage, bed_intersect, bed_map, bed_subtract, bed_window
from .operators.randomize import bed_random, bed_shuffle
from .operators.stats import bed_absdist, bed_fisher, bed_jaccard, bed_projection, bed_reldist
from .operators.transform import bed_flank, bed_makewindows, bed_shift, bed_slop, bed_sort, bound_intervals, flip_strands, interval_spacing
from .schema import check_genome, check_interval, from_one_based, gr_to_bed
from .sources.bed import read_bed, read_bed12, read_bedgraph, read_broadpeak, read_genome, read_gtf, read_narrowpeak, read_vcf, write_bed, write_bedgraph
from .sources.bigbinary import read_bigbed, read_bigwig
from .sources.db import db_ensembl, db_ucsc

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("functions", "operators", "plans", "schema", "sources", "streaming")]
