"""Where the test tables are."""

SF_DIR = "/root/testdata/sf0.001"
