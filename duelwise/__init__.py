"""duelwise: player-impact analytics over elimination feeds, on Spark DataFrames."""
