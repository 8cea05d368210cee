"""Commentary-sentence analytics on Spark: papers in, linked and audited records out."""
