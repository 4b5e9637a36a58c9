"""Share-trend analytics as Spark DataFrame jobs.

For every species (an entity nested in a group), place and span of years: is the species' share of its
group's observations rising or falling?  See README.md for the map of the package.
"""
