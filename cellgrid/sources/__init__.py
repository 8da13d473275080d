"""Readers: Matrix Market, 10x and bustools directories, annotation tables,
value lists, paired FASTQ, tag libraries and the native Parquet dataset."""
