"""The end-to-end jobs: each turns source tables into one score table or the final ranking."""
