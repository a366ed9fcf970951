"""Readers and writers: FASTA, tables mapped to DNA, fragments, reports, workloads, thresholds."""
