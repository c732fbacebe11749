"""Plain versions of the numbered operators, for small tables."""

import collections
import hashlib
import re

def brute1(rows, L=50):
    first={}
    for d,t in rows:
        b=(t or '').encode()
        for s in range(len(b)-L+1):
            w=b[s:s+L]; first[w]=min(first.get(w,d),d)
    out=[]
    for d,t in rows:
        b=(t or '').encode(); c=bytearray(len(b)); e=0
        for s in range(len(b)-L+1):
            if first[b[s:s+L]]<d:
                for i in range(max(s,e),s+L): c[i]=1
                e=s+L
        kept=bytes(x for x,f in zip(b,c) if not f)
        spans=len(re.findall(b'\x01+',bytes(c)))
        out.append((d,len(b),len(b)-len(kept),spans,hashlib.sha256(kept).hexdigest()))
    return sorted(out)
def brute2(rows,L=35):
    cnt=collections.Counter(); W={}
    ws=[re.findall(r'[^\x20\x09-\x0D]+',t or '') for d,t in rows]
    for w in ws:
        for s in range(len(w)-L+1): cnt[tuple(w[s:s+L])]+=1
    out=[]
    for (d,t),w in zip(rows,ws):
        c=[0]*len(w)
        for s in range(len(w)-L+1):
            if cnt[tuple(w[s:s+L])]>1: c[s:s+L]=[1]*L
        kept=[x for x,f in zip(w,c) if not f]
        out.append((d,len(w),len(w)-len(kept),hashlib.sha256(' '.join(kept).encode()).hexdigest()))
    return sorted(out)
def brute5(rows):
    out=[]
    for d,t in rows:
        t=t or ''; w=re.findall(r'[^\x20\x09-\x0D]+',t)
        seen=set(); dl=0
        for l in t.split('\n'):
            if re.search(r'[^\x20\x09-\x0D]',l):
                dl+= l in seen; seen.add(l)
        c=collections.Counter(tuple(w[i:i+8]) for i in range(len(w)-7)); m=[0]*len(w)
        for i in range(len(w)-7):
            if c[tuple(w[i:i+8])]>1: m[i:i+8]=[1]*8
        r=sum(m)
        out.append((d,len(w),sum(map(len,w)),len(re.findall(r'[#*$%&|<>]',t)),dl,r,len(w)<20 or 100*r>30*len(w)))
    return sorted(out)
def brute10(rows,k=2):
    S={}
    for d,t in rows:
        w=re.findall(r'[^\x20\x09-\x0D]+',re.sub('[A-Z]',lambda m:m[0].lower(),t or ''))
        S[d]={tuple(w[i:i+k]) for i in range(len(w)-k+1)} if len(w)>=k else ({tuple(w)} if w else set())
    inv=collections.defaultdict(list)
    for d,s in S.items():
        for x in s: inv[x].append(d)
    P={d:d for d in S}
    def f(x):
        while P[x]!=x: x=P[x]
        return x
    for d in sorted(S):
        c=collections.Counter()
        for x in S[d]:
            for e in inv[x]:
                if e<d: c[e]+=1
        for e,n in c.items():
            if 100*n>=80*(len(S[d])+len(S[e])-n):
                a,b=f(d),f(e); P[max(a,b)]=min(a,b)
    return sorted((d,len(S[d]),f(d),f(d)==d) for d in S)
def brute3(rows,items,L=10):
    W=re.compile(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'); low=lambda t: re.sub('[A-Z]',lambda m:m[0].lower(),t or '')
    ph=collections.defaultdict(set)
    for i,t in items:
        w=W.findall(low(t))
        if 0<len(w)<L: ph[tuple(w)].add(str(i))
        for s in range(len(w)-L+1): ph[tuple(w[s:s+L])].add(str(i))
    sizes={len(p) for p in ph}; out=[]
    for d,t in rows:
        w=W.findall(low(t)); m=[0]*len(w); it=set()
        for n in sizes:
            for s in range(len(w)-n+1):
                k=tuple(w[s:s+n])
                if k in ph: m[s:s+n]=[1]*n; it|=ph[k]
        it=sorted(it)
        out.append((d,len(w),sum(m),len(it),hashlib.sha256(','.join(it).encode()).hexdigest(),sum(m)>0))
    return sorted(out)
