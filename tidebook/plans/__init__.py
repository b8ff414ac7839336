"""Plans that combine operators: the warehouse build and the public queries."""
